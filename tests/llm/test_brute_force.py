"""Operators whose rows no SQL gives, against plain Python versions, and all ten on edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import test_operators as small
from stoa.llm import codepoints as cp
from stoa.llm import decontaminate, langid, licenses, mixing, queries, sharding, shingles, simhash, suffix_dedup, token_codes, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return small.sentence(rng, n)


# op2 ---------------------------------------------------------------------------------------------------------


def naive_words(text):
    out, now = [], None
    for i, c in enumerate(text or ""):
        if c.isalpha():
            now = [i, i + 1] if now is None else [now[0], i + 1]
        elif now is not None:
            out.append(now)
            now = None
    return out + ([now] if now else [])


def naive_bucket(before, c, after):
    h = (before * 0x9E3779B97F4A7C15 ^ c * 0xC2B2AE3D27D4EB4F ^ after * 0x165667B19E3779F9) % 2**64
    return int(cp.mixed(np.array([h], np.uint64))[0] >> np.uint64(48))


def naive_grams(text):
    """Each word's span and the buckets of its characters' trigrams."""
    lower = [c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text]
    out = []
    for a, b in naive_words(text):
        own = []
        for i in range(a, b):
            around = [ord(lower[j]) if 0 <= j < len(text) and text[j].isalpha() else 32 for j in (i - 1, i, i + 1)]
            own.append(naive_bucket(*around))
        out.append((a, b, own))
    return out


def naive_language(texts_by_lang, text, switch=12.0):
    langs = sorted(texts_by_lang)
    counts = {x: {} for x in langs}
    for x in langs:
        for t in texts_by_lang[x]:
            for _, _, own in naive_grams(t):
                for g in own:
                    counts[x][g] = counts[x].get(g, 0) + 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    log_p = lambda x, g: math.log((counts[x].get(g, 0) + 0.5) / (total[x] + 0.5 * 65536))
    words = naive_grams(text or "")
    if not words:
        return "und", 0.0
    best = {x: (0.0, []) for x in langs}
    for k, (_, _, own) in enumerate(words):
        fresh = {}
        for x in langs:
            prev = max(langs, key=lambda y: best[y][0] - (switch if y != x and k else 0))
            if k == 0:
                prev = x
            score = best[prev][0] - (switch if prev != x else 0) + sum(log_p(x, g) for g in own)
            fresh[x] = (score, [*best[prev][1], x])
        best = fresh
    path = max(best.values())[1]
    letters = {}
    for (a, b, _), x in zip(words, path, strict=True):
        letters[x] = letters.get(x, 0) + b - a
    top = max(sorted(letters), key=lambda x: letters[x])
    return top, letters[top] / sum(letters.values())


def test_languages_equal_a_plain_version(spark):
    rng = random.Random(31)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    made = {"aa": ["tion", "the", "ing"], "bb": ["schl", "keit", "ung"], "cc": ["eau", "oui", "ç"]}
    rows = [(i, " ".join(word(made[x]) for _ in range(20)), x) for i, x in enumerate(["aa", "bb", "cc"] * 5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by_lang = {x: [t for _, t, y in rows if y == x] for x in made}
    probes = [" ".join([*(word(made["aa"]) for _ in range(6)), *(word(made["bb"]) for _ in range(9))]), word(made["cc"]), "Keit, THE 12 ungung!", None, "42", ""]
    got = langid.with_language(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for p, r in zip(probes, got, strict=True):
        lang, score = naive_language(by_lang, p)
        assert (r["lang_pred"], round(r["score"], 6)) == (lang, round(score, 6)), p


def test_language_accuracy_held_out(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right >= 0.97 * n and n > 100


# op4 ---------------------------------------------------------------------------------------------------------


def naive_shards(rows, shards, nodes_each=128):
    """``rows``: (cell, hash, id, size). Each in ring order goes clockwise to the first node whose shard has room."""
    nodes = sharding.ring(shards, nodes_each)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out = []
    for cell, h, d, size in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3])):
        at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        while room[nodes[at][1]] == 0:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        out.append((d is not None, d or 0, size, nodes[at][1]))
    return sorted(out)


def test_shards_equal_a_plain_ring(spark):
    rng = random.Random(32)
    rows = [(i if i % 17 else None, sentence(rng, rng.randint(0, 9)) if i % 5 else "one text", "s") for i in range(157)]
    df = spark.createDataFrame(rows, small.DOCS)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    plain = [(r[0], r[1], r[2], len((r[3] or "").encode()) + 8) for r in df.select(F.shiftrightunsigned(h, 48), h, "doc_id", "text").collect()]
    got = sharding.sharded(df, shards=7).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["shard"]) for r in got) == naive_shards(plain, 7)


# op6 ---------------------------------------------------------------------------------------------------------


def naive_notices(text, templates, coverage=0.8, density=0.7):
    spans, now = [], None
    for i, c in enumerate(text + " "):
        if c.isalpha() or c.isdigit():
            now = i if now is None else now
        elif now is not None:
            spans.append((now, i))
            now = None
    words = [text[a:b].lower() for a, b in spans]
    out = []
    for name, template in templates.items():
        own = "".join(c if c.isalpha() or c.isdigit() else " " for c in template.lower()).split()
        need, reach, done = math.ceil(coverage * len(own)), int(len(own) / density), -1
        spots = [i for i, w in enumerate(words) if w in own]
        for k in range(len(spots) - need + 1):
            s = spots[k]
            if s <= done or spots[k + need - 1] - s >= reach:
                continue
            pairs = licenses.patience(words[s : s + reach], own)
            if len(pairs) < need:
                continue
            a, b = s + pairs[0][0], s + pairs[-1][0]
            if len(pairs) / (b - a + 1) >= density:
                out.append((name, round(len(pairs) / len(own), 6), spans[a][0], spans[b][1]))
                done = b
    return sorted(out, key=lambda x: (x[2], x[0]))


def test_notices_equal_a_plain_version(spark):
    rng = random.Random(33)
    rows = []
    for i in range(24):
        parts = [sentence(rng, rng.randint(0, 40))]
        for name in rng.sample(list(licenses.TEMPLATES), rng.randint(0, 3)):
            words = licenses.TEMPLATES[name].split()
            for _ in range(rng.randint(0, max(1, len(words) // 6))):
                words[rng.randrange(len(words))] = rng.choice(small.WORDS)
            parts += [" ".join(words), sentence(rng, rng.randint(0, 30))]
        rows.append((i, "\n".join(parts)))
    got = {r["doc_id"]: r["licenses"] for r in licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert [(x["license"], round(x["coverage"], 6), x["start"], x["end"]) for x in got[i]] == naive_notices(text, licenses.TEMPLATES), i
    assert sum(map(len, got.values())) > 10


# op9 ---------------------------------------------------------------------------------------------------------


def least_edits(probe, text):
    """Edits of ``probe`` against any part of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    codes = np.array([ord(c) for c in text] or [0])[: len(text)]
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(probe):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def plain_hits(docs, items, q=12, length=100, errors=0.05):
    normal = lambda t: " ".join("".join(c.lower() if c.isalpha() or c.isdigit() else " " for c in t or "").split())
    out = set()
    for i, item in items:
        x = normal(item)
        if not x:
            continue
        probes = set()
        if len(x) >= q:
            for wide, step in ((length, length // 2), *[(decontaminate.SHORT, decontaminate.STRIDE)] * (decontaminate.SHORT < min(length, len(x)))):
                n = min(wide, len(x))
                probes |= {(x[s : s + n], min(int(n * errors), max(0, (n - q) // q))) for s in {*range(0, len(x) - n + 1, step), len(x) - n}}
        for d, text in docs:
            y = normal(text)
            if (len(x) < q and f" {x} " in f" {y} ") or any(least_edits(p, y) <= e for p, e in probes):
                out.add((d, i))
    return out


def test_benchmark_hits_equal_all_alignments(spark):
    rng = random.Random(34)
    items = [(k, sentence(rng, rng.choice([12, 25, 40]))) for k in range(5)] + [(5, "short one"), (6, None)]
    docs = []
    for i in range(24):
        words = items[i % 5][1].split()
        for _ in range(i // 6):
            words[rng.randrange(len(words))] = rng.choice(small.WORDS)
        cut = words[: rng.randint(6, len(words))] if i % 3 == 0 else words
        docs.append((i, f"{sentence(rng, 20)}! {' '.join(cut).title()}; {sentence(rng, 20)}" + (" Short one." if i % 7 == 0 else "")))
    got = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == plain_hits(docs, items) and len(got) == len({(r[0], r[1]) for r in got})


# op10 --------------------------------------------------------------------------------------------------------


def plain_toxicity(model, text):
    """Noisy-or over the sentences, from the model's weights."""
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    shift = np.uint64(64 - toxicity.BUCKET_BITS)

    def buckets(word):
        points, _ = cp.joined([word])
        a, b = np.array([0]), np.array([len(word)])
        out = {int(cp.word_hashes(points, a, b)[0] >> shift)}
        return out | {int(h[0] >> shift) for keep, h in cp.prefix_hashes(points, a, b, toxicity.PREFIXES) if len(keep)}

    quiet, text = 1.0, (text or "") + "\n"
    start = 0
    for i, c in enumerate(text):
        if c in ".!?\n\r。！？…":
            own = set()
            for a, b in naive_words(text[start : i + 1]):
                own |= buckets("".join(x.lower() if len(x.lower()) == 1 else x for x in text[start + a : start + b]))
            z = model.bias + sum(weights.get(k, 0.0) for k in own)
            quiet *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
            start = i + 1
    return 1 - quiet


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(35)
    rows = []
    for i in range(300):
        parts = [sentence(rng, 8).capitalize() + rng.choice(".!?") for _ in range(rng.randint(1, 5))]
        toxic = int(i % 4 == 0)
        if toxic:
            parts[rng.randrange(len(parts))] = f"Such {rng.choice(['vilewords', 'nastyword'])} {rng.choice(small.WORDS)}!"
        rows.append((i, " ".join(parts), toxic))
    return rows


def test_scores_equal_a_plain_noisy_or(spark, toxic_rows):
    df = spark.createDataFrame(toxic_rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df)
    probes = [t for _, t, _ in toxic_rows[:40]] + [None, "", "Été. VILEWORDS", "…"]
    got = toxicity.with_toxicity(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for p, r in zip(probes, got, strict=True):
        assert r["score"] == pytest.approx(plain_toxicity(model, p), abs=1e-6), p


def test_one_text_with_most_rows_trains_alike(spark, toxic_rows):
    df = spark.createDataFrame(toxic_rows + [(1000 + i, "one very common text.", 0) for i in range(400)], "doc_id long, text string, toxic int")
    a, b = toxicity.train(df, sample=200), toxicity.train(df.repartition(7), sample=200)
    assert a.buckets.tolist() == b.buckets.tolist() and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    got = queries.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    hit, toxic, alarms, clean = got.agg(F.sum(F.col("toxic") * F.col("predicted")), F.sum("toxic"), F.sum((1 - F.col("toxic")) * F.col("predicted")), F.sum(1 - F.col("toxic"))).first()
    print("held out", hit, toxic, alarms, clean)
    assert hit >= 0.6 * toxic and alarms <= 0.1 * clean


# the pipeline ------------------------------------------------------------------------------------------------


def plain_mix(spark, docs):
    """Copies of each row: keys drawn by Spark's hash, all else in plain Python."""
    df = spark.createDataFrame(docs, DOCS)
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(7)), 11) + 0.5) / float(1 << 53)
    rows = df.select("doc_id", "text", F.col("source"), mixing.word_count(F.col("text")).alias("size"), (-F.log(draw) / F.greatest(mixing.plain_share(F.col("text")), F.lit(1e-6))).alias("key")).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets, copies = small.fair_targets(sizes), {}
    for s, total in sizes.items():
        epochs = int(targets[s] // total) if total else 0
        left, before = targets[s] - epochs * total, 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: r["key"]):
            copies[r["doc_id"]] = epochs + (before + r["size"] / 2 <= left)
            before += r["size"]
    return copies


def test_pipeline_equals_plain_stages(spark, toxic_rows, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(36)
    items = [(k, sentence(rng, 40)) for k in range(3)]
    texts = [t for _, t, _ in toxic_rows]
    near = [sentence(rng, 120).split() for _ in range(6)]
    for words in near:
        texts.append(" ".join(words))
        words[60] = "changed"
        texts += [" ".join(words), " ".join(words)]
    texts += [f"{sentence(rng, 30)} {t} {sentence(rng, 30)}" for _, t in items] + ["Été et ça!", "two words"]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    train = [(t, y) for i, t, y in toxic_rows if zlib.crc32(str(i).encode()) % 4 != 2]
    model = toxicity.train(spark.createDataFrame(train, "text string, toxic int"))
    left = [d for d in docs if plain_toxicity(model, d[1]) < 0.3]
    assert 0 < len(left) < len(docs)
    kept = small.brute_keep_first([(d[0], d[1]) for d in left])
    left = [d for k, d in enumerate(left) if k in kept]
    dirty = {d for d, _ in plain_hits([(d[0], d[1]) for d in left], items)}
    assert dirty
    left = [d for d in left if d[0] not in dirty]
    copies = plain_mix(spark, left)
    library, want, start = Tokenizer.from_file(queries.tokenizer_file()), [], 0
    for d in left:
        for _ in range(copies[d[0]]):
            ids = [*library.encode(d[1], add_special_tokens=False).ids, 2]
            want.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


# edge cases of all ten ---------------------------------------------------------------------------------------


def operators(spark):
    """Each operator as ``documents -> rows``, with small parameters."""
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    lang = langid.LanguageModel(["aa", "bb"], np.zeros((1 << 16, 2), np.float32), np.ones((len(langid._NAMES), 2), bool))
    tox = toxicity.ToxicityModel(np.array([5]), np.array([1.0]), -4.0)
    return {
        "op1": lambda d: token_codes.token_digest(d, queries.tokenizer_file()), "op2": lambda d: langid.with_language(d, lang), "op4": lambda d: sharding.sharded(d, 5), "op5": lambda d: simhash.simhash_groups(d),
        "op6": lambda d: licenses.with_licenses(d), "op7": lambda d: mixing.mixed(d), "op8": lambda d: suffix_dedup.without_repeats(d, n=60), "op9": lambda d: decontaminate.without_benchmark(d, bench), "op10": lambda d: toxicity.with_toxicity(d, tox),
        "keep": lambda d: simhash.keep_first(d), "near": lambda d: shingles.keep_first(d), "repeat": lambda d: mixing.repeated_by_mix(d),
    }


NAMES = ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "keep", "near", "repeat"]


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, name):
    empty = spark.createDataFrame([], DOCS)
    assert operators(spark)[name](empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_null_ids_texts_sources_and_repeats(spark, name):
    rows = [(None, None, None, None, None), (None, "a b c", None, None, 1), (1, "", "x", "s", 0), (2, "same row", "x", "s", 8), (2, "same row", "x", "s", 8), (3, "a b c", None, "t", 5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("score", F.lit("clash")).withColumn("Spans", F.lit(None).cast("int"))
    got = operators(spark)[name](docs).collect()
    if name == "near":
        assert sorted((r["text"] or "") for r in got) == ["", "a b c", "same row"]
    elif name not in ("keep", "repeat"):
        assert len(got) == len(rows)


@pytest.mark.parametrize("name", NAMES)
def test_one_very_long_text(spark, name):
    rng = random.Random(37)
    block = sentence(rng, 2000) + ". "
    text = "".join(f"{block[: -i - 2]} n{i}. " for i in range(0, 380))
    docs = spark.createDataFrame([(1, text, "x", "s", 0), (2, "short", "x", "s", 0)], DOCS)
    assert len(text) > 3_500_000
    got = operators(spark)[name](docs).count()
    assert got >= 1 if name == "repeat" else got == 2


def test_string_ids(spark):
    rows = [(f"d{i}", sentence(random.Random(i % 3), 40), "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = suffix_dedup.digest(suffix_dedup.without_repeats(docs, n=60)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == suffix_dedup.brute_force([t for _, t, _ in rows], 60)
    assert {r["component_id"] for r in simhash.simhash_groups(docs).collect()} == {"d0", "d1", "d2"}


def test_vectors_of_nothing_and_repeated_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(none, none).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (None, [9.0, 9.0]), (1, [1.0, 1.0]), (2, [0.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id = 0"), k=2).collect())
    assert got == [(0, 1, 2, 2 * 256 * 3 * 256), (0, 2, 1, 2 * 256 * 256)]


def test_scores_beyond_a_long_are_refused(spark):
    def top(size):
        df = spark.createDataFrame([(i, [size * (1 + i / 8), size]) for i in range(4)], "vec_id long, embedding array<double>")
        return sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id = 0"), k=2).collect())

    x = 256 * 2**22
    assert top(2.0**22) == [(0, 1, 3, x * (x + x * 3 // 8) + x * x), (0, 2, 2, x * (x + x // 4) + x * x)]
    for size in (1e9, 1e18, 1e300):
        with pytest.raises(OverflowError):
            top(size)
