"""LAS point clouds as tables, read in ranges of records; the file's length, not its header, says how many there are."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from stoa.sources.clouds import _Range, filesystem

# Byte offset of the colours in each LAS point format that has them.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


@dataclass(frozen=True)
class LasHeader:
    body: int
    width: int
    points: int
    stated: int
    tail: int
    scales: tuple[float, ...]
    offsets: tuple[float, ...]
    colour: int | None

    def record(self) -> np.dtype:
        names, kinds, places = ["X", "Y", "Z", "intensity"], ["<i4", "<i4", "<i4", "<u2"], [0, 4, 8, 12]
        if self.colour is not None:
            names, kinds, places = names + ["red", "green", "blue"], kinds + ["<u2"] * 3, places + [self.colour + k for k in (0, 2, 4)]
        return np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": self.width})


def las_header(head: bytes, size: int) -> LasHeader:
    """Of a file of ``size`` bytes: its whole records count, a partial one at the end is ``tail`` bytes. Compressed files are refused."""
    if head[:4] != b"LASF" or len(head) < 227:
        raise ValueError("not a LAS file")
    body, = struct.unpack_from("<I", head, 96)
    form, width, stated = struct.unpack_from("<BHI", head, 104)
    if form & 0xC0:
        raise ValueError("compressed LAS points are not supported")
    if head[25] >= 4 and len(head) >= 255:
        stated = struct.unpack_from("<Q", head, 247)[0] or stated
    numbers = struct.unpack_from("<6d", head, 131)
    points, tail = divmod(max(0, size - body), width)
    return LasHeader(body, width, points, stated, tail, numbers[:3], numbers[3:], COLOUR_AT.get(form))


class _LasReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def head(self) -> LasHeader:
        fs, place = filesystem(self.path)
        with fs.open_input_file(place) as f:
            return las_header(f.read(375), f.size())

    def partitions(self) -> list[_Range]:
        n = self.head().points
        return [_Range(k, min(self.block, n - k)) for k in range(0, n, self.block)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        head = self.head()
        record = head.record()
        fs, place = filesystem(self.path)
        with fs.open_input_file(place) as f:
            for first in range(partition.first, partition.first + partition.count, 1 << 17):
                n = min(1 << 17, partition.first + partition.count - first)
                f.seek(head.body + first * head.width)
                rows = np.frombuffer(f.read(n * head.width), record)
                columns = {"point_id": pa.array(np.arange(first, first + len(rows)))}
                for k, axis in enumerate("xyz"):
                    columns[axis] = pa.array(rows[axis.upper()] * head.scales[k] + head.offsets[k])
                for name in record.names[3:]:
                    columns[name] = pa.array(rows[name].astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)


class LasSource(DataSource):
    """``spark.read.format("las").load(file)``: point_id, x, y, z, intensity and, where the points have them, red, green, blue as stored.

    ``block`` (1,000,000) is the number of records of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> StructType | str:
        colours = ", red int, green int, blue int" if self.reader(None).head().colour is not None else ""
        return "point_id long, x double, y double, z double, intensity int" + colours

    def reader(self, schema) -> _LasReader:
        return _LasReader(self.options["path"], int(self.options.get("block", 1_000_000)))


def byte_colour(value: Column) -> Column:
    """A two-byte colour as 0 to 255."""
    return F.least(F.greatest(F.floor(value / 256), F.lit(0)), F.lit(255)).cast("int")


def with_colours(cloud: DataFrame, colours: tuple[str, str, str] | None = ("red", "green", "blue"), intensity: str = "intensity") -> DataFrame:
    """``cloud`` with ``r, g, b`` from 0 to 255: colours of which any is above 255 are scaled from 65,535.

    Without colours, the intensity between its least and largest value is all three. One aggregated row goes to the tasks.
    """
    if colours:
        top = cloud.agg(F.max(F.greatest(*colours)).alias("_top"))
        scale = F.when(F.col("_top") > 255, F.lit(65535.0) / 255).otherwise(1.0)
        values = [F.col(c) / scale for c in colours]
    else:
        top = cloud.agg(F.min(intensity).alias("_low"), F.max(intensity).alias("_top"))
        span = F.when(F.col("_top") > F.col("_low"), F.col("_top") - F.col("_low")).otherwise(1)
        values = [(F.col(intensity) - F.col("_low")) * 255.0 / span] * 3
    named = [v.alias(n) for v, n in zip(values, "rgb", strict=True)]
    return cloud.join(F.broadcast(top)).select(*[cloud[c] for c in cloud.columns], *named)


def register(spark) -> None:
    spark.dataSource.register(LasSource)
