"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stoa.llm import decontaminate, langid, licenses, mixing, sharding, shingles, simhash, suffix_dedup, token_codes, token_files, topk, toxicity
from stoa.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.choice([0, 1, 3, 40, 90])), f"s{i % 3}") for i in range(40)]
    copy = sentence(rng, 80)
    rows += [(100 + i, copy, "hot") for i in range(20)] + [(130 + i, copy + f" end{i}", "hot") for i in range(6)]
    rows += [(200, None, None), (201, "", None), (None, "no id here", "s1"), (3, "same id again", "s1"), (3, "same id again", "s1"), (202, " ".join(WORDS * 900), "long"), (203, "été Ünïcode ÀÉ, ok.", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, fixture):
    return spark.createDataFrame(fixture, DOCS).repartition(5).withColumn("score", F.lit("clash")).withColumn("Lang_Pred", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(d):
    return (d is not None, d or 0)


# 1 -----------------------------------------------------------------------------------------------------------


def test_codes_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes, used = token_files.Codes.from_bytes(memoryview(token_files.Codes.of(ids).to_bytes()))
        assert used == len(token_files.Codes.of(ids).to_bytes())
        assert [codes[i] for i in range(0, n, 7)] == ids[::7].tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()


def test_token_of_a_data_set_reads_few_bytes(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_codes, "BLOCK_IDS", 500)
    path = str(tmp_path / "codes")
    token_codes.write_codes(docs.select("doc_id", "text"), path, tokenizer_file())
    rows = sorted(token_codes.read_codes(spark, path).collect(), key=lambda r: r["start"])
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows]).tolist()
    assert [token_files.token(path, i) for i in range(0, len(ids), 37)] == ids[::37]
    for i in (-1, len(ids)):
        with pytest.raises(IndexError):
            token_files.token(path, i)

    read = []
    codes = token_files.Codes.of(np.random.default_rng(3).integers(0, 50_000, 100_000, np.uint32))

    class Counted:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            read.append(n)
            return self.data[at : at + n]

    assert token_files._id_at(Counted(codes.to_bytes()), 0, 77_777) == codes[77_777] and sum(read) < 250


def test_words_of_long_texts_stay_whole():
    for text in ("ab " * 100, "x" * 50 + " y", "no_space" * 20, "", "a\nb " * 30):
        parts = [p for _, p in token_codes.cp.pieces(text, 16)]
        assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_token_digest(spark, docs, fixture):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    want, start = [], 0
    for d, t, _ in sorted(fixture, key=lambda r: key(r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_codes.token_digest(docs, tokenizer_file()).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_format_by_name_reads_the_same(spark, docs, tmp_path):
    token_codes.register(spark)
    token_codes.write_codes(docs, str(tmp_path / "a"), tokenizer_file())
    want = sorted(map(tuple, token_codes.read_codes(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert sorted(map(tuple, spark.read.format("dac").load(str(tmp_path / "a")).collect()), key=lambda r: r[1]) == want
    again = token_codes.read_codes(spark, str(tmp_path / "a")).select("doc_id", "ids").orderBy("start").coalesce(1)
    again.write.format("dac").mode("append").save(str(tmp_path / "b"))
    assert sorted(map(tuple, token_codes.read_codes(spark, str(tmp_path / "b")).collect()), key=lambda r: r[1]) == want


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_file()), token_codes._Encoder(tokenizer_file())
    texts = ["Hello, World. it's 3.5x", "a<|endoftext|>b c", "x\x1cy z", "É é é ß, ÀB. ΑΣ Σ.", "don't, STOP.. ,a a, .", "日本語 テキスト、です。", " nb sp", "Ǆ ŉ İ, ı."]
    for t in texts + texts:
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_token_digest_of_nothing(empty):
    assert token_codes.token_digest(empty, tokenizer_file()).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------


def test_language_spans(spark):
    rng = random.Random(1)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    made = {"aa": ["tion", "the", "ing"], "bb": ["schl", "keit", "ung"], "cc": ["при", "вет", "мир"]}
    rows = [(i, " ".join(word(made[x]) for _ in range(40)), x) for i, x in enumerate(["aa", "bb", "cc"] * 15)]
    model = langid.train(spark.createDataFrame([*rows, (90, None, "aa"), (91, "text", None)], "doc_id long, text string, lang string"))
    half = " ".join(word(made["aa"]) for _ in range(20)) + " " + " ".join(word(made["cc"]) for _ in range(30))
    probe = spark.createDataFrame([(1, half, 9), (2, None, 9), (3, "12 34 ,,", 9), (4, word(made["bb"]), 9), (4, word(made["bb"]), 9)], "doc_id long, text string, lang_pred int")
    got = langid.with_language(probe, model).orderBy("doc_id").collect()
    assert [r["lang_pred_"] for r in got] == ["cc", "und", "und", "bb", "bb"]
    assert [s["lang"] for s in got[0]["spans"]] == ["aa", "cc"] and 0.5 < got[0]["score"] < 1
    assert got[1]["score"] == 0 and got[1]["spans"] == []


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 6))
        scores = rng.normal(size=(n, 3))
        cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert cost(langid.viterbi(scores, np.zeros(n, int), 1.5)) == pytest.approx(cost(best))


def test_no_language(spark, empty):
    model = langid.train(empty.withColumn("lang", F.lit("x")))
    got = langid.with_language(spark.createDataFrame([(1, "word")], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "und"


# 3 -----------------------------------------------------------------------------------------------------------


def test_exact_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 4])).tolist()) for i in range(300)]
    vectors += [(400 + i, vectors[5][1]) for i in range(30)] + [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [0.0] * 8), (600, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("norm", F.lit(1))
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 50 = 0"), k=5, bucket_rows=32, query_rows=4).collect())
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("sharp", [0.0, 0.5, 2.0])
def test_both_prunings_keep_the_best(sharp):
    rng = np.random.default_rng(6)
    c = rng.integers(-50, 50, (200, 6))
    c = c[np.argsort(-(c**2).sum(1), kind="stable")]
    q = rng.integers(-50, 50, (9, 6))
    scores = q @ c.T
    theta = np.sort(scores, 1)[:, -4].astype(float)
    row, ids, score = topk.bucket_top(np.full(9, -1), q, theta, np.arange(200), c, 4, coordinates_from=sharp)
    for i in range(9):
        assert sorted(zip(-score[row == i], ids[row == i], strict=True)) == sorted(zip(-scores[i], range(200), strict=True))[:4]


def test_a_repeated_query_id_keeps_all_others():
    rng = np.random.default_rng(13)
    c = rng.integers(-50, 50, (60, 6))
    ids = np.arange(60)
    for copies in (2, 6):
        v = np.concatenate([c, np.repeat(c[:1] * 3, copies, 0)])
        n = np.concatenate([ids, np.zeros(copies, int)])
        order = np.argsort(-(v**2).sum(1), kind="stable")
        v, n = v[order], n[order]
        row, got, score = topk.bucket_top(np.array([0]), c[:1] * 3, np.array([-np.inf]), n, v, 5)
        want = sorted((-int(c[0] @ x) * 3, i) for i, x in zip(n.tolist(), v, strict=True) if i != 0)[:5]
        assert sorted(zip((-score).tolist(), got.tolist(), strict=True)) == want


# 4 -----------------------------------------------------------------------------------------------------------


def test_shards(docs, fixture):
    got = sharding.sharded(docs, 7).collect()
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((key(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in fixture)
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert {len(s) for s in counts.values()} <= {len(fixture) // 7, len(fixture) // 7 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())


def test_overflow_continues_clockwise():
    nodes = [(10, 0), (20, 1), (30, 2)]
    assert sharding.fill([(5, 0, 6), (15, 0, 1), (25, 0, 2)], [3, 3, 3], nodes) == [(5, 0, 0, 3, 0, 0), (5, 0, 3, 6, 1, 0), (15, 0, 0, 1, 2, 0), (25, 0, 0, 2, 2, 1)]


def test_a_ring_grows_by_new_nodes_only():
    assert set(sharding.ring(5, 16)) < set(sharding.ring(6, 16))


def test_shards_of_nothing(empty):
    assert sharding.sharded(empty).count() == 0


# 5 -----------------------------------------------------------------------------------------------------------


def brute_print(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, radius=4):
    comp = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def test_simhash_groups(docs, fixture):
    known = [(d, t) for d, t, _ in fixture if d is not None]
    prints = [brute_print(t) for _, t in known]
    want = sorted((d, f"{p:016x}", c) for (d, _), p, c in zip(known, prints, brute_components(prints, [d for d, _ in known]), strict=True))
    assert sorted(tuple(r) for r in simhash.simhash_groups(docs.where("doc_id is not null")).collect()) == want
    assert simhash.simhash_groups(docs).count() == len(fixture)


@pytest.mark.parametrize("cap", [3, 10_000])
def test_no_link_is_missed(spark, cap):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(8)})
    signed = [p - 2**64 if p >> 63 else p for p in (x & (2**64 - 1) for x in prints)]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, cap)
    from stoa.operators.components import connected_components

    got = {(r["node"], r["component"]) for r in connected_components(links).collect()}
    comp = brute_components([s & (2**64 - 1) for s in signed], signed)
    assert got == {(s, c) for s, c in zip(signed, comp, strict=True) if comp.count(c) > 1}


def test_keep_first(docs, fixture):
    kept = simhash.keep_first(docs.withColumn("_keep", F.lit(1)).withColumn("_row", F.lit(2)))
    assert kept.columns == [*docs.columns, "_keep", "_row"]
    prints = [brute_print(t) for _, t, _ in fixture]
    groups = {}
    for (d, _, _), c in zip(fixture, brute_components(prints, list(range(len(fixture)))), strict=True):
        groups.setdefault(c, []).append((d is None, d or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(min(g) for g in groups.values())


# 6 -----------------------------------------------------------------------------------------------------------


def test_license_notices(spark):
    rng = random.Random(2)
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("hereby granted", "herewith given").replace("deal in", "work with")
    rows = [(1, sentence(rng, 300) + "\n" + mit + "\n" + sentence(rng, 300)), (2, changed), (3, "Released under the MIT License. " * 2), (4, sentence(rng, 500)), (5, None), (6, "")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x["license"] for x in got[1]] == ["MIT"] and rows[0][1][got[1][0]["start"] : got[1][0]["end"]] == mit[:-1]
    assert got[2][0]["license"] == "MIT" and 0.8 <= got[2][0]["coverage"] < 1
    assert [x["license"] for x in got[3]] == ["MIT line"] * 2
    assert got[4] == got[5] == got[6] == []


def test_longest_increasing():
    import itertools

    for values in itertools.permutations(range(6)):
        got = [values[i] for i in licenses.longest_increasing(list(values))]
        longest = max(k for k in range(7) for c in itertools.combinations(values, k) if list(c) == sorted(c))
        assert got == sorted(got) and len(got) == longest


# 7 -----------------------------------------------------------------------------------------------------------


def fair_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
        if not free:
            return target


def test_mixing(docs, fixture):
    got = mixing.mixed(docs.drop("score")).collect()
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((key(r["doc_id"]), r["size"]) for r in got) == sorted((key(d), count(t)) for d, t, _ in fixture)
    sizes = {}
    for _, t, s in fixture:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = fair_targets(sizes)
    by_target = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        a = by_target.setdefault((r["source_size"], round(r["target"], 6)), [0, 0])
        a[0] += r["taken"]
        a[1] = max(a[1], r["size"])
    assert set(by_target) == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert all(abs(taken - t) <= most / 2 + 1 for (_, t), (taken, most) in by_target.items())


def test_mix_repeats_rows(docs):
    known = docs.where("doc_id is not null and doc_id <> 3")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mixed(known).collect()}
    rows = mixing.repeated_by_mix(known)
    assert rows.columns == known.columns
    counts = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {d: n for d, n in plan.items() if n}


def test_mixing_nothing(empty):
    assert mixing.mixed(empty).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------


def test_repeated_windows():
    rng = random.Random(1)
    for _ in range(100):
        n, letters = rng.choice([3, 5, 8]), rng.choice(["ab", "abc", "a"])
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(n, 25))).encode() for _ in range(rng.randint(1, 6))]
        windows = np.array([rng.randint(1, len(p) - n + 1) for p in parts])
        all_ = [p[i : i + n] for p, w in zip(parts, windows, strict=True) for i in range(w)]
        want = [[all_.count(p[i : i + n]) > 1 for i in range(w)] for p, w in zip(parts, windows, strict=True)]
        assert [g.tolist() for g in suffix_dedup.repeated_windows(parts, windows, n)] == want


@pytest.mark.parametrize("hot", [1, 65_536])
def test_suffix_dedup(spark, hot, monkeypatch):
    rng = random.Random(9)
    passage, line = sentence(rng, 30), "same line again and again " * 20
    texts = [sentence(rng, 60), passage, "x" + passage + sentence(rng, 20), sentence(rng, 20) + passage + "y", line, "short", "", None, "é" * 150, "aé" * 75 + passage, passage[3:], "twice " * 3]
    texts += [sentence(rng, 5) + passage + sentence(rng, 5) for _ in range(6)] + [texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n: spans(d, n, hot))
    got = suffix_dedup.digest(suffix_dedup.without_repeats(df, n=60)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == suffix_dedup.brute_force(texts, 60)


# 9 -----------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(k, sentence(rng, 40)) for k in range(5)] + [(7, "tiny"), (8, None), (None, sentence(rng, 40))]
    edited = items[1][1].replace("alpha", "alfa", 1).upper()
    rows = [(1, sentence(rng, 100) + ". " + items[0][1] + "! " + sentence(rng, 100)), (2, edited), (3, sentence(rng, 2000)), (4, None), (5, ""), (6, items[2][1][:60]), (7, items[3][1] + " " + items[4][1]), (7, items[3][1] + " " + items[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 300):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_hits(docs, bench, block_chars=block).collect())
        assert got == [(1, 0), (2, 1), (7, 3), (7, 3), (7, 4), (7, 4)]
        clean = decontaminate.without_benchmark(docs.withColumn("_hit", F.lit(0)), bench, block_chars=block)
        assert clean.columns == [*docs.columns, "_hit"] and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6]


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Short one!"), (2, "zz"), (3, "?!"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "short one"), (2, "a SHORT, one. zz"), (3, "shortone pizza zzz"), (4, "cohort one"), (5, None), (6, "")], "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in decontaminate.benchmark_hits(docs, bench).collect())
    assert got == [(1, 1), (2, 1), (2, 2)]


def test_rows_of_one_id_are_judged_apart(spark):
    rng = random.Random(21)
    item = sentence(rng, 40)
    docs = spark.createDataFrame([(1, item), (1, "clean text"), (1, "clean text"), (None, item), (None, "clean too")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["text"] for r in decontaminate.without_benchmark(docs, bench).collect()) == ["clean text", "clean text", "clean too"]
    kept = mixing.repeated_by_mix(spark.createDataFrame([(1, "a b c", "s"), (1, "d e f g h", "s"), (1, "d e f g h", "s")], "doc_id long, text string, source string"))
    taken = [r["text"] for r in kept.collect()]
    assert abs(sum(len(t.split()) for t in taken) - 1.5 * 13) <= 3 and 1 <= taken.count("a b c") <= 2


def test_windows_of_long_texts_and_common_grams(monkeypatch):
    rng = random.Random(22)
    items = [(k, sentence(rng, 40)) for k in range(6)]
    probes = decontaminate.Probes.of(items, 12, 100, 0.05)
    text = " ".join([sentence(rng, 3000), items[0][1], " . " * 4000, items[1][1], "%" * 9000, sentence(rng, 2000), items[2][1]])
    want = {h[:2] for h in decontaminate.hits_in([text, items[3][1]], probes)}
    assert want == {(0, 0), (0, 1), (0, 2), (1, 3)}
    monkeypatch.setattr(decontaminate, "SLICE_CHARS", 3000)
    found = decontaminate.hits_in([text], probes)
    assert {h[1] for h in found} == {0, 1, 2} and all(normal(text[s:e]) in normal(items[i][1]) for _, i, s, e, _ in found)
    monkeypatch.setattr(decontaminate, "ENTRIES", 500)
    assert {h[:2] for h in decontaminate.hits_in([text, items[3][1]], probes)} == want


def normal(text):
    return " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())


def test_items_without_id_are_found(spark):
    rng = random.Random(15)
    texts = [sentence(rng, 40) for _ in range(3)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, sentence(rng, 300))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (0, texts[2]), (None, None)], "item_id long, text string")
    for block in (4_000_000, 300):
        got = decontaminate.benchmark_hits(docs, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, None), (2, None), (3, 0)} and len(got) == 3
    assert [r["doc_id"] for r in decontaminate.without_benchmark(docs, bench).collect()] == [4]


def test_short_excerpts_at_every_offset():
    rng = random.Random(14)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(40))
    probes = decontaminate.Probes.of([(5, item)], 12, 100, 0.05)
    for at in range(len(item) - 72):
        some = item[at : at + 72].strip()[:70]  # blanks at the ends don't count
        some += item[item.index(some) + len(some)] * (len(some) < 70)
        for text in (some, f"{sentence(rng, 30)} - {some} - {sentence(rng, 30)}"):
            assert [h[:2] for h in decontaminate.hits_in([text], probes)] == [(0, 5)], at


def test_banded_distance_equals_full():
    rng = np.random.default_rng(8)
    for _ in range(30):
        p, t = rng.integers(0, 3, (1, 10)), rng.integers(0, 3, (1, 14))
        d = np.zeros(15, int)
        for i in range(10):
            n = np.concatenate([[i + 1], np.zeros(14, int)])
            for j in range(14):
                n[j + 1] = min(d[j] + (p[0, i] != t[0, j]), d[j + 1] + 1, n[j] + 1)
            d = n
        wide = np.concatenate([np.full((1, 10), 9), t, np.full((1, 10), 9)], 1)
        assert decontaminate.banded_distance(p, wide)[0][0] == d.min()


# 10 ----------------------------------------------------------------------------------------------------------


def test_toxicity_finds_sentences(spark):
    rng = random.Random(4)
    bad = ["vileword", "nastyword"]
    rows = []
    for i in range(400):
        parts = [sentence(rng, 8).capitalize() + "." for _ in range(rng.randint(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] = parts[k][:-1] + f" {rng.choice(bad)} {rng.choice(WORDS)}."
        rows.append((i, " ".join(parts), int(toxic)))
    train = spark.createDataFrame([*rows[:300], (900, None, 1), (901, "text", None)], "doc_id long, text string, toxic int")
    model = toxicity.train(train)
    probe = spark.createDataFrame([*rows[300:], (950, None, 0), (951, "", 0)], "doc_id long, text string, score int")
    got = toxicity.with_toxicity(probe, model).collect()
    assert all(r["predicted"] == r["score"] and 0 <= r["score_"] <= 1 for r in got)
    hit = next(r for r in got if r["score"] == 1)
    assert len(hit["sentences"]) == 1
    assert any(b in hit["text"][hit["sentences"][0]["start"] : hit["sentences"][0]["end"]] for b in bad)


def test_no_toxic_label(spark):
    model = toxicity.train(spark.createDataFrame([(1, "a text", 0)], "doc_id long, text string, toxic int"))
    assert toxicity.with_toxicity(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), model).first()["predicted"] == 0


# pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        if name == "mixing":
            assert docs.select("doc_id").distinct().count() == docs.count() >= out.select("doc_id").distinct().count()
        else:
            assert 0 < out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == docs.count() and before > docs.select("doc_id").distinct().count()


def brute_shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_keep_first(rows):
    """Indexes of ``(id, text)`` rows kept: the first by id of each group closed over shingle similarity of 0.8."""
    sets = [brute_shingles(t) for _, t in rows]
    near = lambda a, b: a == b or len(a & b) * 5 >= len(a | b) * 4
    left, kept = set(range(len(rows))), set()
    while left:
        group = todo = {left.pop()}
        while todo:
            todo = {j for j in left for i in todo if near(sets[i], sets[j])}
            left -= todo
            group = group | todo
        kept.add(min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)))
    return kept


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(11)
    rows = []
    for k in range(40):  # pairs with some words changed: similarity from 0.5 to 1
        words = sentence(rng, 200).split()
        rows.append((10 * k, " ".join(words)))
        for at in rng.sample(range(0, 200, 10), k % 8 + 1):
            words[at] = "changed"
        rows.append((10 * k + 1, " ".join(words).upper()))
    chain = [f"w{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(12)]  # each near its neighbours only
    return rows + [(2000, None), (2001, ""), (2002, "two words"), (2003, "two  Words"), (2004, sentence(rng, 5)), (None, rows[0][1]), (None, sentence(rng, 50))]


@pytest.mark.parametrize("blocks", [(2048, 1_000_000), (4, 300)])
def test_near_copies_by_shingles(spark, near_rows, blocks):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").withColumn("H", F.lit(1)).repartition(3)
    kept = shingles.keep_first(docs, block_rows=blocks[0], block_shingles=blocks[1])
    assert kept.columns == docs.columns
    want = [near_rows[i] for i in brute_keep_first(near_rows)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((d is None, d or 0, t or "") for d, t in want)


def test_bands_reach_the_similarity():
    rng = np.random.default_rng(12)
    for n in (9, 90, 900):  # similarity 0.8 exactly
        for _ in range(100):
            x = rng.integers(0, 2**64, n + n // 9, np.uint64)
            a, b = x[:n], np.concatenate([x[: n - n // 9], x[n : n + n // 9]])
            assert set(shingles.band_keys(a)) & set(shingles.band_keys(b))


def test_pipeline_drops_near_copies(spark, near_rows):
    import corpus_pipeline

    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies_out(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == {near_rows[i][0] for i in brute_keep_first(near_rows)}


def test_fingerprint_groups_meet(spark, near_rows):
    """Place -1 of a document is its SimHash group: texts linked within four bits, closed over links, as by all pairs."""
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").where("doc_id is not null")
    told = docs.select(F.col("doc_id").alias("h"), shingles._described(F.col("text"), 5).alias("t")).select("h", "t.n", "t.fp", "t.bands")
    got = {r["h"]: r["key"] for r in shingles.meetings(told).where("band = -1").collect()}
    prints = {d: simhash.majority(shingles.shingles(shingles.split_words(t)).astype(">u8").tobytes()) for d, t in near_rows if d is not None and (t or "").strip()}
    group = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if group[a] != group[b] and bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 4:
                old, new = group[a], group[b]
                group = {d: new if g == old else g for d, g in group.items()}
    by = lambda m: {frozenset(d for d in m if m[d] == k) for k in m.values()}
    assert by(got) == by(group) and 1 < len(by(got)) < len(got)


def test_encoder_keeps_words_beyond_a_task():
    own = token_codes._Encoder(tokenizer_file())
    text = " ".join("".join("abcdefghij"[int(d)] for d in str(k)) for k in range(170_000))
    ids = own(text)
    own.forget()
    made, piece = [], own._piece
    own._piece = lambda word: made.append(word) or piece(word)
    assert own(text) == ids and not made


def test_encoder_cuts_plain_texts_at_marks():
    """Words are encoded once with whatever marks at their ends, and every mix of letters, marks and digits as the library does."""
    import random

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_file()), token_codes._Encoder(tokenizer_file())
    made, piece = [], own._piece
    own._piece = lambda word: made.append(word) or piece(word)
    own("Zürich, (zürich) ZÜRICH... *zürich* zürich; zürich-zürich, (")
    assert sum("ürich".encode("latin1") in w for w in made) == 1
    random.seed(11)
    some = ["a", "S", "it", "É", "ß", "ÿ", "Þ", "7", "'", "'", ".", ",", "**", "<|", "|>", "-", " ", "\n", "\x0b", "t", "re", "×", "\x7f", "\xa0", "\x85", "Σ", "e\u0301", "\x00"]
    for k in range(3000):
        text = "".join(random.choices(some[: 21 if k % 3 else None], k=random.randrange(25)))
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
    for text in ["<|ENDOFTEXT|> a", "A<|EndOfText|>b", "'S 'll '.'s ''re .'t"]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
