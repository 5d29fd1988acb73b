"""Token ids as directly addressable codes, in files of their own format.

An id is cut into chunks of ``BITS`` bits, lowest first. Level ``l`` holds chunk ``l`` of every id that has
one, a bitmap that says whether a next chunk follows, and a rank directory (set bits before each 512-bit
block). Token ``i`` is read with one byte of each level it has: the rank of its continuation bit is its place
in the next level. Nothing else is decoded.

A shard file is a chain of blocks and, at its end, a directory of them (place in the file, first id, first row),
so ``token`` finds any id of a data set by a few reads of some bytes each, whatever the files hold.

A data set is a folder of shard files, named in doc-id order, and ``_manifest.json`` with each shard's rows,
ids and the ids of all shards before it. ``spark.read.format("dac")`` and ``df.write.format("dac")`` work once
``TokenCodes`` is registered; a write's shards become visible only by the manifest that its commit writes.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC, BITS, BLOCK = b"DACIDS02", 8, 512
BLOCK_IDS = 1 << 18  # of a block at least, and one document more
_POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(chunks, continuation bitmap, rank directory)`` for each level; no level for no ids."""
    rest = np.asarray(ids, np.uint64)
    out = []
    while len(rest):
        chunks = (rest & np.uint64(2**BITS - 1)).astype(np.uint8)
        rest >>= np.uint64(BITS)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(_POPCOUNT[bitmap], np.arange(0, len(bitmap), BLOCK // 8))
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u8")
        out.append((chunks, bitmap, ranks))
        rest = rest[more]
    return out


class Codes:
    """Ids in levels, each with chunks, bitmap and ranks: random access, or a slice at once."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        return cls(len(ids), levels_of(ids))

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // BLOCK
        first = block * BLOCK // 8
        ones = int(ranks[block]) + int(_POPCOUNT[bitmap[first : i // 8]].sum())
        return ones + bin(int(bitmap[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else ones

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Id ``i``, by its own bytes and one rank in each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bitmap, ranks, i), shift + BITS
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b``, exclusive, as unsigned 32-bit integers."""
        out = np.zeros(max(0, b - a), np.uint32)
        at, shift = np.arange(len(out)), 0
        for chunks, bitmap, ranks in self.levels:
            if a >= b:
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            first = self._rank(bitmap, ranks, a)
            a, b, at, shift = first, first + int(bits.sum()), at[bits], shift + BITS
        return out

    def to_bytes(self) -> bytes:
        """Number of ids and levels, the sizes of each level's parts, then the parts."""
        sizes = [struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)) for chunks, bitmap, ranks in self.levels]
        parts = [part for chunks, bitmap, ranks in self.levels for part in (chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u8").tobytes())]
        return b"".join([struct.pack("<QQ", self.n, len(self.levels)), *sizes, *parts])

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[Codes, int]:
        """The codes at the start of ``data``, and the bytes that they take."""
        n, count = struct.unpack_from("<QQ", data)
        sizes = struct.unpack_from(f"<{3 * count}Q", data, 16)
        at, levels = 16 + 24 * count, []
        for k in range(count):
            arrays = []
            for size, kind in zip(sizes[3 * k : 3 * k + 3], (np.uint8, np.uint8, "<u8"), strict=True):
                arrays.append(np.frombuffer(data, kind, size, at))
                at += arrays[-1].nbytes
            levels.append(tuple(arrays))
        return cls(n, levels), at


# --- files -------------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def _write_block(out, docs: list[int | None], ids: list[np.ndarray]) -> tuple[int, int]:
    """One block: its documents' ids, lengths and codes, so a shard is written in bounded memory.

    Gives its number of ids and the place of its codes from its start."""
    lengths = np.fromiter(map(len, ids), "<u8", len(ids))
    codes = Codes.of(np.concatenate(ids) if ids else np.zeros(0, np.uint32)).to_bytes()
    known = np.packbits([d is not None for d in docs], bitorder="little").tobytes()
    head = struct.pack("<QQ", len(docs), len(codes))
    front = head + known + np.array([d or 0 for d in docs], "<i8").tobytes() + lengths.tobytes()
    out.write(front)
    out.write(codes)
    return int(lengths.sum()), len(front)


def read_blocks(path: str) -> Iterator[tuple[list[int | None], np.ndarray, Codes]]:
    """``(doc ids, lengths, codes)`` of each block of a shard file."""
    fs, place = _filesystem(path)
    with fs.open_input_stream(place) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"not a file of token codes: {path}")
        while head := f.read(16):
            n, size = struct.unpack("<QQ", head)
            if not size:  # the directory follows
                break
            known = np.unpackbits(np.frombuffer(f.read(-(-n // 8)), np.uint8), bitorder="little")[:n]
            docs = [int(d) if k else None for d, k in zip(np.frombuffer(f.read(8 * n), "<i8"), known, strict=True)]
            lengths = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
            yield docs, lengths, Codes.from_bytes(memoryview(f.read(size)))[0]


def directory(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """``(place of the codes in the file, ids before, rows before)`` of each block of an open shard."""
    size = file.size()
    entries, magic = struct.unpack("<Q8s", file.read_at(16, size - 16))
    if magic != MAGIC:
        raise ValueError("not a whole file of token codes")
    flat = struct.unpack(f"<{3 * entries}Q", file.read_at(24 * entries, size - 16 - 24 * entries))
    return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))


def _id_at(file: pa.NativeFile, place: int, i: int) -> int:
    """Id ``i`` of the codes at ``place``: a byte, a bit and a rank of each level that the id has."""
    _, count = struct.unpack("<QQ", file.read_at(16, place))
    sizes = struct.unpack(f"<{3 * count}Q", file.read_at(24 * count, place + 16))
    at, value = place + 16 + 24 * count, 0
    for level in range(count):
        chunks, bitmap, ranks = sizes[3 * level : 3 * level + 3]
        value |= file.read_at(1, at + i)[0] << BITS * level
        first = i // BLOCK * BLOCK // 8
        bits = file.read_at(i // 8 + 1 - first, at + chunks + first)  # at most a block's 64 bytes
        if not bits[-1] >> (i % 8) & 1:
            break
        before = int.from_bytes(bits, "little") & ((1 << (i % BLOCK)) - 1)
        (rank,) = struct.unpack("<Q", file.read_at(8, at + chunks + bitmap + 8 * (i // BLOCK)))
        i, at = rank + before.bit_count(), at + chunks + bitmap + 8 * ranks
    return value


def token(path: str, i: int) -> int:
    """Id ``i`` of the data set in ``path``, counted over all documents in their order.

    Reads the manifest, one shard's directory and at most 73 bytes a level; no block is decoded.
    """
    reader = CodesReader(path)
    shards = [s for s in reader.partitions() if s.file]
    at = bisect.bisect_right([s.start for s in shards], i) - 1
    if i < 0 or at < 0:
        raise IndexError(i)
    fs, place = _filesystem(f"{reader.path}/{shards[at].file}")
    with fs.open_input_file(place) as file:
        blocks = directory(file)
        own = bisect.bisect_right([b[1] for b in blocks], i - shards[at].start) - 1
        codes, before, _ = blocks[own]
        (n,) = struct.unpack("<Q", file.read_at(8, codes))
        if i - shards[at].start - before >= n:
            raise IndexError(i)
        return _id_at(file, codes, i - shards[at].start - before)


class Written(WriterCommitMessage):
    def __init__(self, shard: int, file: str, rows: int, ids: int):
        self.shard, self.file, self.rows, self.ids = shard, file, rows, ids


class CodesWriter(DataSourceArrowWriter):
    """Each task writes one shard under a name of its own; the commit names those that count."""

    def __init__(self, path: str, block_ids: int):
        self.path, self.block_ids = path.rstrip("/"), block_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.dac"
        fs, place = _filesystem(f"{self.path}/{file}")
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        rows = total = held = 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        places: list[tuple[int, int, int]] = []
        with fs.open_output_stream(place) as out:
            out.write(MAGIC)

            def block() -> None:
                nonlocal rows, total, held, docs, ids
                at = out.tell()
                more, front = _write_block(out, docs, ids)
                places.append((at + front, total, rows))
                rows, total, held, docs, ids = rows + len(docs), total + more, 0, [], []

            for batch in iterator:
                for d, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    docs.append(d)
                    ids.append(np.frombuffer(raw.as_buffer() or b"", "<u4"))
                    held += len(ids[-1])
                    if held >= self.block_ids:
                        block()
            if docs:
                block()
            out.write(struct.pack("<QQ", 0, 0))  # no more blocks
            out.write(struct.pack(f"<{3 * len(places)}Q", *[v for p in places for v in p]) + struct.pack("<Q8s", len(places), MAGIC))
        return Written(shard, file, rows, total)

    def commit(self, messages: list[Written | None]) -> None:
        start, shards = 0, []
        for m in sorted((m for m in messages if m), key=lambda m: m.shard):
            if m.rows:
                shards.append({"file": m.file, "rows": m.rows, "ids": m.ids, "start": start})
                start += m.ids
        fs, place = _filesystem(f"{self.path}/_manifest.json")
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(place) as out:
            out.write(json.dumps({"bits": BITS, "ids": start, "shards": shards}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                fs, place = _filesystem(f"{self.path}/{m.file}")
                fs.delete_file(place)


class _Shard(InputPartition):
    def __init__(self, file: str, start: int):
        self.file, self.start = file, start


class CodesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[_Shard]:
        fs, place = _filesystem(f"{self.path}/_manifest.json")
        with fs.open_input_stream(place) as f:
            manifest = json.loads(f.read())
        return [_Shard(s["file"], s["start"]) for s in manifest["shards"]] or [_Shard("", 0)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        start = partition.start
        for docs, lengths, codes in read_blocks(f"{self.path}/{partition.file}"):
            ends = np.cumsum(lengths)
            raw = codes.slice(0, len(codes)).astype("<u4").tobytes()
            ids = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
            start += int(ends[-1]) if len(ends) else 0


class TokenCodes(DataSource):
    """Format ``dac``. Writes ``(doc_id long, ids binary)``, ids being little-endian unsigned 32-bit integers, in
    the order of the partitions and of the rows in them; reads ``doc_id, start, n_tokens, ids``."""

    SCHEMA = "doc_id long, start long, n_tokens long, ids binary"

    @classmethod
    def name(cls) -> str:
        return "dac"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> CodesReader:
        return CodesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> CodesWriter:
        return CodesWriter(self.options["path"], int(self.options.get("blockids", BLOCK_IDS)))
