"""Files of fixed-width records written by all tasks at once: PLY, LAS and NPY clouds.

Two phases. First the rows go to the shared folder, which fixes their order, and each partition's rows are counted; then every
task writes the records of the rows that it reads at their own places in the one file. A task that runs again writes
the same bytes to the same places. The driver sees a count for each partition and writes the header.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.session import written

PLY_RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
LAS_RECORD = np.dtype(
    [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
)


def mounted(path: str) -> str:
    """The place of ``path`` in a mounted file system; stores without writing at offsets are refused."""
    if re.match(r"file:/", path):
        return unquote(urlparse(path).path)
    if re.match(r"\w[\w+.-]*:/", path):
        raise ValueError(f"{path}: records are written at offsets, which needs a mounted file system; use format 'ply' there")
    return path


def packed(batch: pa.RecordBatch, record: np.dtype) -> np.ndarray:
    """The batch's columns, named as the record's fields, as records. Whole numbers are clipped to their type and null ones are 0; null reals are NaN. Fields without a column are 0."""
    body = np.zeros(batch.num_rows, record)
    for name in record.names:
        if name not in batch.schema.names:
            continue
        column, kind = batch.column(name), record[name]
        if kind.kind == "f":
            body[name] = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        else:
            limit = np.iinfo(kind)
            body[name] = np.clip(column.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), limit.min, limit.max)
    return body


def write_records(df: DataFrame, path: str, record: np.dtype, header: Callable[[int], bytes]) -> int:
    """Writes the rows of ``df`` as one file, in the order of its partitions and of the rows within them; returns their number.

    ``header`` makes the file's beginning from the number of rows. The file appears under its name when it is whole.
    """
    place = mounted(path)
    fields = [F.col(n) for n in record.names if n in df.columns]
    rows = written(df.select(*fields, F.monotonically_increasing_id().alias("_id")), "records")
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    head, draft, width = header(total), f"{place}.{uuid.uuid4().hex}", record.itemsize
    with open(draft, "wb") as out:
        out.write(head)
        out.truncate(len(head) + total * width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(draft, "r+b") as out:
            for batch in batches:
                ids = batch.column("_id").to_numpy()
                body = packed(batch, record)
                for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):  # rows that follow each other
                    if len(run):
                        first = int(ids[run[0]])
                        out.seek(len(head) + (starts[first >> 33] + (first & ((1 << 33) - 1))) * width)
                        out.write(body[run[0] : run[-1] + 1].tobytes())
                n += len(ids)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    done = rows.mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    if done != total:
        os.remove(draft)
        raise RuntimeError(f"{done} of {total} records written")
    os.replace(draft, place)
    return total


def write_ply(cloud: DataFrame, path: str) -> int:
    """``x, y, z`` as floats and ``red, green, blue``, clipped to bytes, as a binary PLY file."""
    kinds = {"<f4": "float", "|u1": "uchar"}
    fields = "".join(f"property {kinds[PLY_RECORD[n].str]} {n}\n" for n in PLY_RECORD.names)
    return write_records(cloud, path, PLY_RECORD, lambda n: f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{fields}end_header\n".encode())


def write_npy(cloud: DataFrame, path: str) -> int:
    """``x, y, z`` and, where the cloud has all of them, ``r, g, b`` as an array of floats, a row a point."""
    names = [c for c in "xyzrgb" if {"r", "g", "b"} <= set(cloud.columns) or c in "xyz"]
    record = np.dtype([(c, "<f4") for c in names])

    def header(n: int) -> bytes:
        text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({n}, {len(names)}), }}"
        text += " " * (-(len(text) + 11) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode()

    return write_records(cloud, path, record, header)


def write_las(cloud: DataFrame, path: str, scale: float = 0.001, stated: int | None = None) -> int:
    """``x, y, z`` and, where they are there, ``intensity, red, green, blue`` as a LAS 1.2 file of point format 2.

    Places are whole multiples of ``scale`` from the least whole number of each axis; a cloud too wide for that is refused, as are
    points without a place. ``stated`` is the number of points that the header claims, by default the true one.
    """
    axes = ["x", "y", "z"]
    ends = cloud.agg(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("low", F.min), ("high", F.max))], F.count_if(F.greatest(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in axes])).alias("lost")).first()
    if ends["lost"]:
        raise ValueError(f"{ends['lost']} points without a place")
    low, high = ([float(ends[f"{n}_{c}"] or 0) for c in axes] for n in ("low", "high"))
    offsets = [float(np.floor(v)) for v in low]
    if any((h - o) / scale >= 1 << 31 for h, o in zip(high, offsets, strict=True)):
        raise ValueError("the cloud is too wide for its scale")
    whole: Callable[[str, float], Column] = lambda c, o: F.round((F.col(c) - o) / scale).cast("long").alias(c.upper())
    more = [c for c in ("intensity", "red", "green", "blue") if c in cloud.columns]

    def header(n: int) -> bytes:
        head = bytearray(227)
        head[:4] = b"LASF"
        head[24:26] = b"\x01\x02"
        struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 2, LAS_RECORD.itemsize, (n if stated is None else stated) & 0xFFFFFFFF)
        struct.pack_into("<6d", head, 131, scale, scale, scale, *offsets)
        struct.pack_into("<6d", head, 179, *[v for pair in zip(high, low, strict=True) for v in pair])
        return bytes(head)

    return write_records(cloud.select(*[whole(c, o) for c, o in zip(axes, offsets, strict=True)], *more), path, LAS_RECORD, header)
