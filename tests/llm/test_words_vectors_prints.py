"""Spelling variants, whitening and fingerprints against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stoa.llm import fingerprints, queries, spellings, whitening

SF = "/root/testdata/sf0.001"


# op11 --------------------------------------------------------------------------------------------------------


def plain_counts(rows, shortest=6, least=5, thinned=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if thinned and h % thinned == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= shortest:
                n[word] += 1
    return {w: k for w, k in n.items() if k >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, times=5):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= times * n[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return sorted(((a, form[a], root(a), n[a], len(near[a]), n.get(form[a])) for a in n), key=repr)


def got_variants(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_spelling_variants_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_variants(plain_counts([tuple(r) for r in docs.collect()]))
    got = got_variants(queries.op11_spelling_variants(spark, SF))
    assert got == want and len(want) > 500 and sum(w[1] is not None for w in want) > 0


def test_every_edit_of_a_word_is_found(spark):
    """Insertions, deletions and replacements at every place, chains of forms, ties, letters outside ASCII."""
    base = "grenzfall"
    n = {base: 1000, "grenzfäll": 150, "grenzfäl": 20, "grenzfäls": 2}
    for i in range(len(base)):
        n.setdefault(base[:i] + base[i + 1 :], 7)
        n.setdefault(base[:i] + "é" + base[i + 1 :], 9)
        n.setdefault(base[:i] + "z" + base[i:], 400)
    rng = random.Random(11)
    for _ in range(300):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 9)))
        n.setdefault(w, rng.choice([5, 5, 25, 125]))
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(7)
    assert got_variants(spellings.variants(df)) == plain_variants(n)


def test_words_of_odd_rows(spark):
    rows = [(None, "Straßen straßen STRAßEN"), (1, None), (2, ""), (2, "Straßen " * 5), (2, "Straßen " * 5), (3, "short Ünder×x÷y " * 6), (4, "a" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["word"]: r["n"] for r in spellings.word_counts(docs).collect()}
    assert got == plain_counts(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spellings.variants(spellings.word_counts(none)).collect() == []


def test_one_edit_flips_at_most_two_bits():
    rng = random.Random(5)
    for _ in range(500):
        w = [chr(rng.choice([rng.randrange(97, 123), rng.randrange(0xC0, 0x100)])) for _ in range(8)]
        v, i = list(w), rng.randrange(8)
        v[i : i + rng.randrange(2)] = [chr(rng.randrange(97, 123))] * rng.randrange(2)
        apart = spellings.letter_mask("".join(w)) ^ spellings.letter_mask("".join(v))
        assert apart.bit_count() <= 2 and any(not apart & m for m in spellings.band_masks())


# op12 --------------------------------------------------------------------------------------------------------


def test_products_of_digits_are_exact():
    rng = np.random.default_rng(3)
    for top in (9, 1 << 20, 1 << 45, 1 << 61):
        y = rng.integers(-top, top, (70, 5))
        assert (whitening.gram(y) == y.astype(object).T @ y.astype(object)).all()
    huge = np.array([[10**25, -3], [7, 10**22]], object)
    assert (whitening.gram(huge) == huge.T @ huge).all()


def plain_whitening(x, k):
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    w = np.array([[float(Fraction(c, n)) for c in r] for r in y]) @ q / np.sqrt(e)
    return [sum(c * c for c in r) for r in y], w, e / np.trace(v)


def test_whitening_of_a_table(spark):
    got = queries.op12_whitening(spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in r] for r in raw["embedding"]]
    deviation, w, explained = plain_whitening(x, 8)
    got = got.sort_values(["vec_id", "component"])
    order = np.argsort(raw["vec_id"].to_numpy(), kind="stable")
    assert got["deviation"].tolist() == [deviation[i] for i in order for _ in range(8)] and set(got["n"]) == {len(x)}
    own = got["whitened"].to_numpy().reshape(-1, 8)
    signs = np.sign((own * w[order]).sum(0))
    assert np.abs(own * signs - w[order]).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:8] / explained - 1).max() < 1e-12 and got["identity_error"].max() < 1e-10


def test_small_eigenvalues_keep_their_digits():
    """Variances from 1e18 to 1e8 in a turned basis: relative errors of values stay small."""
    a = np.diag([10**18, 10**12, 10**8]).astype(object)
    turn = np.array([[3, -4, 0], [4, 3, 0], [0, 0, 5]], object)  # five times a rotation
    axes, values, explained = whitening.leading(turn @ a @ turn.T, 1, 3)
    assert values == pytest.approx([25e18, 25e12, 25e8], rel=1e-8) and np.abs(axes.T @ axes - np.eye(3)).max() < 1e-15


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -3.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [-4.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    model = whitening.fit(df)
    got = whitening.whitened(df, model, whitening.identity_error(df, model)).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == {(1, 1): 2, (1, 2): 2, (8, 1): 1, (8, 2): 1, (None, 1): 1, (None, 2): 1}
    assert {r["vec_id"] for r in got} == {1, None, 8} and {r["n"] for r in got} == {4} and len(got) == 8
    for none in (df.limit(0), spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")):
        model = whitening.fit(none)
        assert whitening.whitened(none, model, whitening.identity_error(none, model)).collect() == []
    with pytest.raises(Exception, match="2\\*\\*62"):
        whitening.fit(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>"))


# op13 --------------------------------------------------------------------------------------------------------


def plain_edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, follow = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[: len(text) - half] + follow[:half]).encode()).hexdigest())
    return out


def shingles(text):
    out = Counter()
    for p in (text or "").split("\n"):
        words = re.split("[ \t\x0b\f\r]+", p.strip(" \t\x0b\f\r"))
        if p:
            out.update(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return out


def cosine(a, b):
    if a == b:
        return 1.0
    dot = sum(n * b[s] for s, n in a.items())
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5 if a and b else 0.0


@pytest.mark.parametrize("sizes", [(4000, 256), (3, 8), (1, 2)])
def test_edited_texts_and_likeness(spark, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in fingerprints.edited(docs, range_rows=sizes[0], coarse=sizes[1]).collect()}
    want = plain_edits(rows)
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == want
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for k, (i, text) in enumerate(order):
        follow = order[(k + 1) % len(order)][1] or ""
        half = len(text or "") // 2
        changed = (text or "")[: len(text or "") - half] + follow[:half]
        errors += [got[i]["near_edited"] - max(0, cosine(shingles(text), shingles(changed))), got[i]["near_next"] - max(0, cosine(shingles(text), shingles(follow)))]
    assert np.sqrt(np.mean(np.square(errors))) < 1.5 / fingerprints.LANES**0.5 and np.abs(errors).max() < 5 / fingerprints.LANES**0.5


def test_paragraphs_add_up_whatever_their_order(spark):
    a, b, c = "one two three four five six", "a b", "  spaced   out\twords here and there "
    texts = ["\n".join(p) for p in ([a, b, c], [c, a, b], [a, b], [c], [a, a, b], [])] + ["\n\n\n", None, f"{a}\n\n{c}\n{b}\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    prints = {r["k"]: r["fingerprint"] for r in fingerprints.fingerprints(df, ["k"]).collect()}
    assert prints[0] == prints[1] == prints[8] and len({prints[k] for k in (0, 2, 3, 4, 5)}) == 5 and prints[5] == prints[6] == prints[7]
    two = spark.createDataFrame([(prints[2], prints[3], prints[0], prints[5])], "ab string, c string, abc string, none string")
    got = two.select(fingerprints.added("ab", "c"), fingerprints.removed("abc", "ab"), fingerprints.removed("c", "c"), fingerprints.likeness("abc", "abc"), fingerprints.likeness("abc", "none"), fingerprints.likeness("none", "none")).first()
    assert tuple(got) == (prints[0], prints[3], prints[5], 1.0, 0.0, 1.0)


def test_prints_of_odd_rows(spark):
    rows = [(None, "x\ny"), (None, None), (1, "same"), (1, "same"), (1, "other"), (5, ""), (9, "long line " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("place", F.lit(None).cast("int"))
    got = fingerprints.edited(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 4}) == 1
    assert fingerprints.edited(docs.limit(0)).collect() == []
    only = fingerprints.edited(docs.where("doc_id = 9")).first()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256((rows[-1][1][:300_000] * 2).encode()).hexdigest()


def test_no_python_on_the_native_path(spark):
    plan = queries.op13_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
