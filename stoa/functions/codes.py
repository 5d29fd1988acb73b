"""Space-filling and packed keys as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (shift, mask) steps that put two zero bits after each of 16 bits.
SPREAD = ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249))


def _spread(v: Column) -> Column:
    v = v.cast("long").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """Bits of x, y and z in turn, z lowest; 16 bits of each."""
    return F.shiftleft(_spread(x), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(z))


def ravel(index: list[Column], shape: list[int]) -> Column:
    """Mixed-radix key of an index, the last axis fastest."""
    out = index[0].cast("long")
    for i, n in zip(index[1:], shape[1:], strict=True):
        out = out * n + i
    return out


def _gathered(v: Column) -> Column:
    """Undoes ``_spread``: every third bit, packed."""
    v = v.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(SPREAD), [m for _, m in reversed(SPREAD[:-1])] + [0xFFFF], strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def unmorton(code: Column) -> list[Column]:
    """x, y and z of a Morton code."""
    return [_gathered(F.shiftright(code, k)) for k in (2, 1, 0)]


def _hilbert_steps(x: Column, y: Column, z: Column, bits: int, back: bool) -> Column:
    """Skilling's exchanges of lower bits, from the highest bit down or, to undo them, from the lowest up."""
    turns = [(1 << b, d) for b in range(bits - 1, 0, -1) for d in range(3)]
    plan = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(d).alias("d")) for q, d in (reversed(turns) if back else turns)])

    def step(s: Column, t: Column) -> Column:
        own = F.when(t["d"] == 0, s["x"]).when(t["d"] == 1, s["y"]).otherwise(s["z"])
        low = t["q"] - 1
        on = own.bitwiseAND(t["q"]) != 0
        swap = F.when(on, F.lit(0).cast("long")).otherwise(s["x"].bitwiseXOR(own).bitwiseAND(low))
        first = s["x"].bitwiseXOR(F.when(on, low).otherwise(swap))
        return F.struct(first.alias("x"), F.when(t["d"] == 1, s["y"].bitwiseXOR(swap)).otherwise(s["y"]).alias("y"), F.when(t["d"] == 2, s["z"].bitwiseXOR(swap)).otherwise(s["z"]).alias("z"))

    return F.aggregate(plan, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z")), step)


def hilbert(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Place on the Hilbert curve of a cube of ``2**bits`` cells a side; at most 16 bits."""

    def mixed_with(shift: int):
        return lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, shift))

    def binary(s: Column) -> Column:
        code = morton(s["x"], s["y"], s["z"])
        for shift in (32, 16, 8, 4, 2, 1):
            code = F.transform(F.array(code), mixed_with(shift))[0]  # an array of one: the code is made once
        return code

    return F.transform(F.array(_hilbert_steps(x, y, z, bits, False)), binary)[0]


def unhilbert(code: Column, bits: int = 10) -> Column:
    """``struct<x, y, z>`` of a place on the curve."""
    gray = F.transform(F.array(code), lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 1)))
    axes = F.transform(gray, lambda g: F.struct(*[v.alias(a) for a, v in zip("xyz", unmorton(g), strict=True)]))
    return F.transform(axes, lambda s: _hilbert_steps(s["x"], s["y"], s["z"], bits, True))[0]


def fnv(index: list[Column]) -> Column:
    """The 64-bit FNV-1 style hash of whole numbers, multiplied then mixed, by 32-bit halves so nothing overflows."""
    # fixed values: the offset basis, and the prime as 2**40 + 435
    low, high = F.lit(0x84222325).cast("long"), F.lit(0xCBF29CE4).cast("long")
    word = 0xFFFFFFFF
    state = F.struct(high.alias("h"), low.alias("l"))

    def step(s: Column, v: Column) -> Column:
        small = s["l"] * 435
        big = s["h"] * 435 + F.shiftright(small, 32) + F.shiftleft(s["l"].bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(big.bitwiseAND(F.lit(word)).bitwiseXOR(F.shiftrightunsigned(v, 32)).alias("h"), small.bitwiseAND(F.lit(word)).bitwiseXOR(v.bitwiseAND(F.lit(word))).alias("l"))

    return F.aggregate(F.array(*[i.cast("long") for i in index]), state, step, lambda s: F.shiftleft(s["h"], 32).bitwiseOR(s["l"]))
