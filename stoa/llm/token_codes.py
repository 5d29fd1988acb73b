"""Token ids of whole texts, written as directly addressable codes (see ``token_files``) and read back."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoa.llm import codepoints as cp
from stoa.llm.memory import give_back, small_batches
from stoa.llm.token_files import BLOCK_IDS, CodesReader, CodesWriter, TokenCodes, Written
from stoa.session import scratch


def register(spark: SparkSession) -> None:
    """Makes the format ``dac`` known, for reading and writing by name."""
    spark.dataSource.register(TokenCodes)


# --- encoding ----------------------------------------------------------------------------------------------

# letters whose lower case is the normaliser's, composed, then marks: one pre-token each
_SHAPE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
# of Latin-1; texts of these and ASCII white space alone are handled as bytes
_LETTERS, _DIGITS = bytes([*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]), b"0123456789"
_MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_LOWER = bytes(b + 32 if b in range(65, 91) or b in range(0xC0, 0xDF) and b != 0xD7 else b for b in range(256))  # the normaliser's
_PLAIN = bytes(b for b in range(256) if _LOWER[b] in _LETTERS + _DIGITS + _MARKS + b" \t\n\v\f\r")


def _plain(text: str) -> bytes | None:
    """``text`` in lower case, of one byte a character, or none if it has others."""
    try:
        raw = text.encode("latin1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _PLAIN) else raw.translate(_LOWER)


def _apart(raw: bytes) -> list[bytes]:
    """The parts of a plain text, cut at white space and at the ends of its runs of marks: each has whole pre-tokens.

    Marks aren't cut from an apostrophe, which may start a pre-token with letters or be one with marks.
    """
    for k in _MARKS:
        mark = b"%c" % k
        if mark in raw and mark != b"'":
            raw = raw.replace(mark, b"\x1c%c\x1d" % k)
    raw = raw.replace(b"\x1d\x1c", b"").replace(b"'\x1c", b"'").replace(b"\x1d'", b"'")
    return raw.replace(b"\x1c", b" ").replace(b"\x1d", b" ").split()


PARTS = 320_000  # held of a task at most, and those of one more piece of text


class _Parts(dict):
    """Ids of parts, each made when it is first asked for; long ones aren't kept."""

    def __init__(self, make: Callable[[str | bytes], bytes], longest: int):
        self.make, self.longest = make, longest

    def __missing__(self, part: str | bytes) -> bytes:
        ids = self.make(part)
        if len(part) <= self.longest:
            self[part] = ids
        return ids


class _Encoder:
    """Ids of whole texts by a tokenizer file whose pre-tokens never cross white space.

    A text of ASCII and Latin-1 letters is cut at white space and marks (``_apart``), any other at white space alone, into
    parts that are encoded once. Those of the first kind, in lower case, are kept beyond the task: the last ``keep`` to
    ``2 * keep`` of them, some 200 bytes each. Texts with a special token's string or an information separator are encoded whole.
    """

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special += ["\x1c", "\x1d", "\x1e", "\x1f"]  # str.split takes these for white space, the tokenizer doesn't
        table = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(table)]
        self.bytes = {b: chr(b) for b in table} | {b: chr(256 + k) for k, b in enumerate(rest)}  # the byte-level alphabet
        self.keep, self.words, self.older = keep, _Parts(lambda piece: self._piece(piece), 32), {}
        self.parts = _Parts(self._part, 1 << 30)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a plain part in lower case."""
        ids = self.older.get(piece)
        if ids is not None:
            return ids
        word = piece.decode("latin1")
        if piece.translate(None, _LETTERS) and piece.translate(None, _MARKS):  # not one pre-token
            return self._whole(word)
        if not piece.isascii():
            word = word.encode().decode("latin1").translate(self.bytes)
        ids = [t.id for t in self.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        shape = _SHAPE.fullmatch(part)
        if shape is None:
            return self._whole(part)
        word, marks = shape.groups()
        return self.words[_plain(word)] + (self.words[marks.encode()] if marks else b"")

    def forget(self) -> None:
        self.parts.clear()

    def __call__(self, text: str) -> bytes:
        lower = text.lower()  # a part in lower case must not become a special token
        if any(s in text or s in lower for s in self.special):
            return self._whole(text)
        out = []
        for _, piece in cp.pieces(text):
            plain = _plain(piece)
            out.append(b"".join(map(self.parts.__getitem__, piece.split()) if plain is None else map(self.words.__getitem__, _apart(plain))))
            if len(self.parts) > PARTS:
                self.forget()
            if len(self.words) > self.keep:
                self.older, self.words = self.words, _Parts(self.words.make, 32)
        return b"".join(out)


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)  # one for each Python worker


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    """``(doc_id, ids)`` of ``(doc_id, text)`` rows, some texts at a time: a batch's ids are never all held."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = _encoder(tokenizer)
    end = b"" if end_id is None else struct.pack("<I", end_id)
    for batch in batches:
        for at, some in cp.slices(t.as_py() for t in batch.column(1)):
            ids = pa.array([encoder(t) + end for t in some], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), ids], names=["doc_id", "ids"])
    encoder.forget()


def write_codes(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2) -> None:
    """The ids of every whole text as directly addressable codes in ``path``, in ascending order of id.

    Null ids come first; rows of equal id follow their text's hash, so equal rows are the only ties. The table
    is dealt by ranges of (id, text hash), so one id with many rows still spreads over tasks unless the rows are
    equal. An empty table makes an empty data set.

    Tasks write the shards and give a row each; the manifest then names those of the attempts that succeeded.
    This goes by tasks and not by the format's name, whose planning leaves some seven Python processes of 45 MB
    on the driver. One worker a task encodes and writes, by batches of bounded bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    writer = CodesWriter(path, BLOCK_IDS)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = writer.write(_encoded(batches, tokenizer, end_id))
        give_back()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([m.shard], pa.int32()), "file": [m.file], "rows": [m.rows], "ids": [m.ids]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    ranged = narrow.repartitionByRange(parts, "d", "h").sortWithinPartitions("d", "h")
    wrote = ranged.select("d", "t").mapInArrow(shard, "shard int, file string, rows long, ids long").collect()  # a row for each task
    writer.commit([Written(*row) for row in wrote])


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a data set; ``ids`` are little-endian unsigned 32-bit integers."""
    reader = CodesReader(path)
    shards = reader.partitions()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from reader.read(shards[k])
        give_back()

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(blocks, TokenCodes.SCHEMA)


def token_digest(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Writes ``docs`` as token codes in the shared folder and describes each document from the files read back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-codes")
    write_codes(docs, path, tokenizer, doc_id, text, end_id)
    return read_codes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
