"""Document fingerprints as a homomorphic multiset hash of paragraphs, in DataFrame functions alone.

A paragraph is a non-empty piece between line feeds. It is hashed to a wide vector of two parts, and a text's fingerprint
is the sum of its paragraphs' vectors, each component modulo 2**32:

* ``EXACT`` components of 32 bits, hashes of the whole paragraph under several seeds: equal for two texts if and only if
  (but for a chance of about 2**-512) both hold the same paragraphs equally often, in whatever order;
* ``LANES`` components to which each of the paragraph's shingles adds 1 or -1 at one place, both by its hash. The cosine of
  two texts' lanes estimates the cosine of their shingle multisets, with a standard error of at most ``1 / sqrt(LANES)`` about.

Sums don't depend on order, two texts' sums add up to that of both, and a paragraph is taken out again by subtraction, so
fingerprints follow an edit without the text. Fingerprints are strings: base64 of the components, 4 bytes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoa.session import broadcast_if_small

EXACT, LANES = 16, 128
WIDTH = EXACT + LANES
SHINGLE = 5
MODULUS = 1 << 32
_ENTRY = 1 << 62


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != "")


def _entries(paragraph: Column) -> Column:
    """A paragraph's vector as codes, ``array<long>``: an entry (from ``_ENTRY`` on) of a lane and 32 bits, or a shingle's hash.

    A shingle is five words in a row, hashed word by word; a paragraph of fewer words is one shingle. The empty paragraph,
    which each text gets, has an entry of zero in each lane.
    """
    entry = lambda lane, v: v + (_ENTRY + (lane << 32))
    hashes = [F.xxhash64(F.lit(j), paragraph) for j in range(EXACT // 2)]
    whole = F.array(*[entry(2 * j + k, half) for j, h in enumerate(hashes) for k, half in enumerate((h.bitwiseAND(F.lit(MODULUS - 1)), F.shiftrightunsigned(h, 32)))])
    words = F.transform(F.split(F.btrim(paragraph, F.lit(" \t\x0b\f\r")), r"[ \t\x0B\f\r]+", -1), lambda w: F.xxhash64(w))
    shingle = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]).bitwiseAND(F.lit(_ENTRY - 1))
    shingles = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: shingle(w, i)))[0]
    return F.when(paragraph == "", F.array(*[entry(lane, F.lit(0)) for lane in range(WIDTH)])).otherwise(F.concat(whole, shingles))


def _summed(rows: DataFrame, keys: list[str], paragraphs: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys, carried`` and ``_v``, the components of the paragraphs in an array column, over all rows of a key.

    ``carried`` are numbers, the same in all rows of a key; as maxima they don't lengthen the key that each entry is added under.
    """
    # arrays are made in a projection before they are taken apart: generators of plain columns are compiled, lambdas aren't.
    # None is empty; a plain explode would make each once more, to filter out empty ones
    held = [*keys, *carried]
    each = rows.select(*held, F.concat(F.col(paragraphs), F.array(F.lit(""))).alias("_all")).select(*held, F.explode_outer("_all").alias("_p"))
    spread = each.select(*held, _entries(F.col("_p")).alias("_codes")).select(*held, F.explode_outer("_codes").alias("_e"))
    entry, e = F.col("_e") >= _ENTRY, F.col("_e")
    lane = F.when(entry, F.shiftright(e, 32).bitwiseAND(F.lit(255))).otherwise(EXACT + e.bitwiseAND(F.lit(LANES - 1)))
    value = F.when(entry, e.bitwiseAND(F.lit(MODULUS - 1))).otherwise(1 - 2 * F.shiftright(e, 32).bitwiseAND(F.lit(1)))
    same = [F.max(c).alias(c) for c in carried]
    lanes = spread.select(*held, lane.alias("_lane"), value.alias("_n")).groupBy(*keys, "_lane").agg(F.sum("_n").alias("_n"), *same)
    all_ = F.sort_array(F.collect_list(F.col("_lane") * F.lit(MODULUS) + F.pmod("_n", F.lit(MODULUS))))  # WIDTH entries
    found = lanes.groupBy(*keys).agg(all_.alias("_m"), *same)
    return found.select(*held, F.transform("_m", lambda x: x.bitwiseAND(F.lit(MODULUS - 1))).alias("_v"))


def packed(components: Column) -> Column:
    """The fingerprint string of ``array<long>`` components."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(components, lambda x: F.lpad(F.hex(x), 8, "0")), ""))), "\r\n", "")


def components(fingerprint: Column) -> Column:
    """The components of a fingerprint string."""
    raw = F.hex(F.unbase64(fingerprint))
    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.conv(F.substr(raw, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of two fingerprints."""
    return packed(F.zip_with(components(a), components(b), lambda x, y: F.pmod(x + y, F.lit(MODULUS))))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint ``a`` without the paragraphs of ``b``, which ``a`` holds."""
    return packed(F.zip_with(components(a), components(b), lambda x, y: F.pmod(x - y, F.lit(MODULUS))))


def _signed(v: Column) -> Column:
    """The lanes, those from half the modulus on as negative numbers."""
    return F.transform(F.slice(v, EXACT + 1, LANES), lambda c: F.when(c >= MODULUS // 2, c - MODULUS).otherwise(c).cast("double"))


def _likeness(a: Column, b: Column) -> Column:
    x, y = _signed(a), _signed(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    lengths = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, 1.0).when(lengths == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / lengths)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two texts' shingle multisets from their fingerprints, 0 to 1; equal fingerprints have 1."""
    return _likeness(components(a), components(b))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, fingerprint``: one row for each distinct ``keys``, of all texts that bear them together.

    Null and empty texts and those of line feeds alone have no paragraph: all components are zero. Paragraphs are compared
    as they stand, spaces and case included. Null keys are keys. An empty table gives no row.
    """
    rows = docs.select(*keys, _paragraphs(F.col(text)).alias("_paragraphs"))
    return _summed(rows, keys, "_paragraphs").select(*keys, packed(F.col("_v")).alias("fingerprint"))


def _ranges(docs: DataFrame, doc_id: str, rows: int, coarse: int) -> Column:
    """A number that grows with the id: ``coarse`` quantiles, each cut evenly so that about ``rows`` ids share one; null ids have -1."""
    found = docs.agg(F.count(doc_id).alias("n"), F.percentile_approx(doc_id, [k / coarse for k in range(1, coarse)], 10_000).alias("at"), F.min(doc_id).alias("lo"), F.max(doc_id).alias("hi")).first()
    if not found["n"]:
        return F.lit(-1).cast("long")
    inner = sorted({v for v in found["at"] if found["lo"] < v <= found["hi"]})
    parts = max(1, -(-found["n"] // (rows * (len(inner) + 1))))
    at = F.size(F.filter(F.array(*[F.lit(v) for v in inner]), lambda v: v <= F.col(doc_id))) if inner else F.lit(0)
    if parts == 1:
        number = at
    else:
        edge = F.array(*[F.lit(v) for v in [found["lo"], *inner, found["hi"]]])
        lo, hi = F.get(edge, at), F.get(edge, at + 1)
        number = at * parts + F.least(F.lit(parts - 1), F.floor((F.col(doc_id) - lo) / F.greatest(hi - lo, F.lit(1)) * parts))
    return F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(number).cast("long")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = 4000, coarse: int = 256) -> DataFrame:
    """Each document, its edited text and the document after it, by fingerprint.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. The next document is
    that of the next smaller id, the largest again after the smallest; the edited text has its last ``n_chars // 2`` code points
    replaced by the first as many of the next text. Ids are whole numbers; rows of one id follow each other by length and
    hash of their texts, rows without id come last. Null texts are empty. One document is its own next.

    Ids are cut into ranges of about ``range_rows``, and each range's first row also goes to the range before, so texts
    are shuffled once and each next text is at hand in its range.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("range", _ranges(docs.select(F.col(doc_id).cast("long").alias("doc_id")), "doc_id", range_rows, coarse))
    order = Window.orderBy("range")  # a row a range
    firsts = docs.groupBy("range").agg(F.max("doc_id").alias("first"))
    firsts = firsts.select("range", "first", F.lead("range").over(order).alias("before"), F.min("range").over(Window.partitionBy()).alias("lowest"))
    firsts = broadcast_if_small(firsts.select("range", "first", F.coalesce("before", "lowest").alias("copy_to"), F.col("before").isNull().alias("wraps")), 1_000_000)
    met = docs.join(firsts, "range")
    own = F.struct(F.col("range").alias("at"), F.lit(0).alias("turn"))
    copy = F.struct(F.col("copy_to").alias("at"), F.when(F.col("wraps"), 2).otherwise(1).alias("turn"))
    placed = met.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, copy)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.*")
    n = F.length("text")
    rows = Window.partitionBy("at").orderBy("turn", F.col("doc_id").desc_nulls_last(), n, F.xxhash64("text"))
    follow = placed.select("at", "turn", "doc_id", "text", F.row_number().over(rows).alias("place"), F.coalesce(F.lead("text").over(rows), F.lit("")).alias("next"))
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    texts = follow.select("at", "turn", "place", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("turn") == 0, changed).otherwise(F.lit("")).alias("edited"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    sha = [F.conv(F.substr(F.sha2("edited", 256), F.lit(1 + 16 * k), F.lit(16)), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    carried = ("turn", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3")
    spread = texts.select("at", "place", *carried[:3], *sha, both.alias("_both")).select("at", "place", *carried, F.explode_outer("_both").alias("v"))
    spread = spread.select("at", (F.col("place") * 2 + F.col("v.kind")).alias("slot"), *carried, _paragraphs(F.col("v.text")).alias("_paragraphs"))
    summed = _summed(spread, ["at", "slot"], "_paragraphs", carried)
    beside = Window.partitionBy("at").orderBy("slot")
    seen = summed.withColumns({"_edited": F.lead("_v", 1).over(beside), "_next": F.lead("_v", 2).over(beside)}).where("slot % 2 = 0 and turn = 0")
    hexed = F.concat(*[F.lpad(F.lower(F.hex(f"sha{k}")), 16, "0") for k in range(4)])
    return seen.select(
        "doc_id", "n_chars", hexed.alias("edited_sha256"), packed(F.col("_v")).alias("fingerprint"), packed(F.col("_edited")).alias("edited_fingerprint"),
        F.round(_likeness(F.col("_v"), F.col("_edited")), 12).alias("near_edited"), F.round(_likeness(F.col("_v"), F.col("_next")), 12).alias("near_next"),
    )
