"""Point-cloud files as tables: binary PLY (read and write) and NPY, read in ranges of records.

Files are opened through Arrow's file systems, so any path that executors share works.
"""

from __future__ import annotations

import ast
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# PLY scalar types, by both of their names, as little-endian records.
PLY_TYPES = {
    "char": "<i1", "int8": "<i1", "uchar": "<u1", "uint8": "<u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
SQL_TYPES = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
WIDER = {"u1": "i2", "u2": "i4", "u4": "i8"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def ply_header(head: bytes) -> tuple[int, int, np.dtype]:
    """``(bytes of the header, vertices, record)``. Only little-endian binary; no list in a vertex; x, y, z must be there."""
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    size = head.index(b"\n", end) + 1
    count, fields, inside, form = 0, [], False, ""
    for words in (line.split() for line in head[:end].decode("ascii").splitlines()):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            if words[1] == "list":
                raise ValueError("a vertex with a list property has no fixed width")
            fields.append((words[2], PLY_TYPES[words[1]]))
    if form != "binary_little_endian":
        raise ValueError(f"PLY format {form!r} is not supported")
    if not {"x", "y", "z"} <= {n for n, _ in fields}:
        raise ValueError("a PLY cloud needs x, y and z")
    return size, count, np.dtype(fields)


def npy_header(head: bytes) -> tuple[int, int, np.dtype]:
    """The same of an NPY file of shape [N, 3] or [N, 6]: x, y, z and r, g, b."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    at, n = (10, struct.unpack_from("<H", head, 8)[0]) if head[6] == 1 else (12, struct.unpack_from("<I", head, 8)[0])
    meta = ast.literal_eval(head[at : at + n].decode("latin1"))
    shape = meta["shape"]
    if len(shape) != 2 or shape[1] not in (3, 6) or meta["fortran_order"]:
        raise ValueError(f"a cloud has shape [N, 3] or [N, 6] in rows, not {shape}")
    return at + n, shape[0], np.dtype([(c, meta["descr"]) for c in "xyzrgb"[: shape[1]]])


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, parse, block: int):
        self.path, self.parse, self.block = path, parse, block

    def head(self) -> tuple[int, int, np.dtype]:
        fs, place = filesystem(self.path)
        with fs.open_input_file(place) as f:
            return self.parse(f.read(65_536))

    def partitions(self) -> list[_Range]:
        count = self.head()[1]
        return [_Range(k, min(self.block, count - k)) for k in range(0, count, self.block)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        size, _, record = self.head()
        fs, place = filesystem(self.path)
        with fs.open_input_file(place) as f:
            for first in range(partition.first, partition.first + partition.count, 1 << 17):
                n = min(1 << 17, partition.first + partition.count - first)
                f.seek(size + first * record.itemsize)
                rows = np.frombuffer(f.read(n * record.itemsize), record)
                columns = [pa.array(np.arange(first, first + len(rows)))]
                for name in record.names:
                    kind = record[name].str[1:]
                    columns.append(pa.array(rows[name].astype(WIDER.get(kind, kind))))
                yield pa.RecordBatch.from_arrays(columns, names=["point_id", *record.names])


class _Message(WriterCommitMessage):
    def __init__(self, part: int, file: str, rows: int):
        self.part, self.file, self.rows = part, file, rows


class _PlyWriter(DataSourceArrowWriter):
    """Tasks write bodies; the commit writes the header and appends the bodies in order of partition."""

    RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Message:
        from pyspark import TaskContext

        file, rows = f"{self.path}.part-{uuid.uuid4().hex}", 0
        fs, place = filesystem(file)
        with fs.open_output_stream(place) as out:
            for batch in iterator:
                body = np.zeros(batch.num_rows, self.RECORD)
                for name, column in zip(self.RECORD.names, batch.columns, strict=True):
                    values = column.to_numpy(zero_copy_only=False)
                    body[name] = np.clip(values, 0, 255) if name in ("red", "green", "blue") else values
                out.write(body.tobytes())
                rows += batch.num_rows
        return _Message(TaskContext.get().partitionId(), file, rows)

    def commit(self, messages: list[_Message | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.part)
        kinds = {"<f4": "float", "|u1": "uchar"}
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {sum(m.rows for m in parts)}"]
        lines += [f"property {kinds[self.RECORD[n].str]} {n}" for n in self.RECORD.names] + ["end_header", ""]
        fs, place = filesystem(self.path)
        with fs.open_output_stream(place) as out:
            out.write("\n".join(lines).encode())
            for m in parts:
                own, part = filesystem(m.file)
                with own.open_input_stream(part) as f:
                    while block := f.read(1 << 22):
                        out.write(block)
                own.delete_file(part)

    def abort(self, messages: list[_Message | None]) -> None:
        for m in messages:
            if m:
                fs, place = filesystem(m.file)
                fs.delete_file(place)


class PlyCloud(DataSource):
    """Format ``ply``: ``point_id`` and the vertex properties. Writes ``x, y, z, r, g, b`` as floats and bytes."""

    parse = staticmethod(ply_header)

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        record = self.reader(None).head()[2]
        return ", ".join(["point_id bigint", *(f"`{n}` {SQL_TYPES[record[n].str[1:]]}" for n in record.names)])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.parse, int(self.options.get("block", 5_000_000)))

    def writer(self, schema, overwrite: bool) -> _PlyWriter:
        return _PlyWriter(self.options["path"])


class NpyCloud(PlyCloud):
    """Format ``npycloud``: ``point_id`` and the columns of an [N, 3] or [N, 6] array."""

    parse = staticmethod(npy_header)

    @classmethod
    def name(cls) -> str:
        return "npycloud"


def register(spark) -> None:
    spark.dataSource.register(PlyCloud)
    spark.dataSource.register(NpyCloud)
