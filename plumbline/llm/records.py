"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record file is a run of frames, each ::

    u64 payload length | u32 masked CRC-32C of those 8 bytes | payload | u32 masked CRC-32C of the payload

all little-endian, the framing that readers of this format expect. A payload is a header (i64 doc_id, u32 number of ids,
u16 bytes per id, u16 flags with bit 0 for a null doc_id) and the ids, two bytes each where the vocabulary allows.

Files are shards of a total order; the index is a Parquet table with one row per record: path, shard, record, offset,
length, doc_id, n_tokens. It is committed by Spark, and only files it names count: a task that is repeated writes another
file, and the file of the lost attempt is never read.

Defined cases: a null or empty text is a document of the end id alone; a null doc_id sorts first; repeated doc_ids stay
separate records, in the order of a hash of their texts; an empty table gives an empty index and no file; extra columns
are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.crc32c import crc32c, masked
from plumbline.llm.shared import written

HEADER = struct.Struct("<qIHH")
LENGTH = struct.Struct("<QI")
CHECK = struct.Struct("<I")
FRAME = LENGTH.size + CHECK.size
NULL_ID = 1
BATCH_BYTES = 1 << 22  # payload bytes that are framed or checked together
WRITTEN = "path string, shard int, record long, offset long, length long, doc_id long, n_tokens long"
READ = "path string, shard int, record long, doc_id long, local_start long, n_tokens long, ids_crc32 long"

# The pattern that splits text before the merges, for Latin letters, digits, ASCII punctuation and white space; any other
# character is a piece that only the library can tell.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_MARKS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷"
_WHITE = " \\t\\n\\r"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+|[^{_LETTERS}0-9{_MARKS}{_WHITE}]+")
_PLAIN_PIECE = re.compile(rf"[{_LETTERS}0-9{_MARKS}{_WHITE}]+")


def _byte_symbols() -> dict[int, int]:
    """The character a byte-level vocabulary writes for each byte: itself where it prints, else the next one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


_SYMBOL = _byte_symbols() | {0: 0}


#: What the quick path takes for granted of a tokenizer's file. Any other file is left to the library.
_PLAIN = {
    "normalizer": None, "truncation": None, "padding": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def _is_plain(tokenizer) -> bool:
    found = json.loads(tokenizer.to_str())

    def same(want, has) -> bool:
        if isinstance(want, dict):
            return isinstance(has, dict) and all(same(v, has.get(k)) for k, v in want.items())
        # what an older file leaves out is off, but for the pattern, which is on
        return has == want or has is None and want is False or has in ("", None) and want is None

    return same(_PLAIN, found)


class _Other(Exception):
    """A piece that only the library can cut."""


class Encoder:
    """Ids of whole texts, by a byte-level BPE of the tokenizers library, as little-endian integers.

    Merges never cross the pieces that the vocabulary's pattern cuts a text into, so the library's ids are kept for pieces, in
    a cache of bounded size. The library itself encodes a text with a character outside Latin letters, digits and ASCII
    punctuation, or with the string of an added token, and all texts when its file asks for anything but plain byte-level pieces.
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = _is_plain(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.pieces = _Kept(self._piece, cache)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _PLAIN_PIECE.fullmatch(piece):
            raise _Other
        # a visible ASCII character is its own symbol
        symbols = "Ġ" + piece[1:] if piece[0] == " " and piece[1:].isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(_SYMBOL)
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(a in text for a in self.added):
            return self.whole(text)
        try:
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        except _Other:
            return self.whole(text)
        finally:
            self.pieces.trim()


class _Kept(dict):
    """A cache in two generations: when the young one is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def drop(self) -> None:
        self.clear()
        self.old = {}

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def frames(payloads: list[bytes]) -> Iterator[bytes]:
    """Each payload with its length and both checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    for p, n, a, b in zip(payloads, lengths, masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()):
        yield n + CHECK.pack(a) + p + CHECK.pack(b)


def _write_shards(tokenizer: str, end_id: int, folder: str, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    encoder = _encoder(tokenizer)
    end = np.array([end_id], encoder.dtype).tobytes()
    width = len(end)
    path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
    out, offset, record = None, 0, 0

    def flush(payloads, ids, counts):
        nonlocal out, offset, record
        if out is None:
            store, at = pafs.FileSystem.from_uri(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            out = store.open_output_stream(at)
        sizes = np.array([len(p) + FRAME for p in payloads])
        for frame in frames(payloads):
            out.write(frame)
        offsets = offset + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        offset += int(sizes.sum())
        n = len(payloads)
        record += n
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.array([task.partitionId()] * n, pa.int32()), pa.array(range(record - n, record), pa.int64()),
             pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())],
            names=["path", "shard", "record", "offset", "length", "doc_id", "n_tokens"],
        )

    try:
        payloads, ids, counts, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = encoder.encode(text.as_py()) + end
                n = len(body) // width
                payloads.append(HEADER.pack(doc_id or 0, n, width, NULL_ID * (doc_id is None)) + body)
                ids.append(doc_id)
                counts.append(n)
                held += len(body)
                if held >= BATCH_BYTES:
                    yield flush(payloads, ids, counts)
                    payloads, ids, counts, held = [], [], [], 0
        if payloads:
            yield flush(payloads, ids, counts)
    finally:
        if not keep:
            encoder.pieces.drop()
        if out is not None:
            out.close()


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, order: tuple[str, ...] = ("doc_id",), shards: int | None = None, keep: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) as record files below ``folder`` and return the index, which is written beside them.

    Shard s holds the s-th range of the ``order`` columns, sorted, nulls first. There are ``shards`` of them, else as many as
    ``spark.sql.shuffle.partitions``. With ``keep`` the Python workers hold on to their caches (some 150 MB each at most) from task to
    task, which suits a job of nothing else; without, that memory is free for what the session does next.
    """
    keys = [F.col(f"_key{i}").asc_nulls_first() for i in range(len(order))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_key{i}") for i, c in enumerate(order)]
    ).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(_shards(docs.sparkSession, shards), *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    index = rows.select("doc_id", "text").mapInArrow(partial(_write_shards, tokenizer, end_id, f"{folder}/records", keep), WRITTEN)
    return written(index, "", f"{folder}/index")


def _shards(spark: SparkSession, shards: int | None) -> int:
    return shards or int(spark.conf.get("spark.sql.shuffle.partitions"))


def frames_of(stream, where: str) -> Iterator[tuple[list[bytes], list[int]]]:
    """Payloads and their offsets, a bounded number of bytes at a time; a torn or altered frame is an error."""
    left, base = b"", 0
    while block := stream.read(BATCH_BYTES):
        data = left + block
        at, parts, lengths, checks, offsets = 0, [], [], [], []
        while at + LENGTH.size <= len(data):
            n, check = LENGTH.unpack_from(data, at)
            end = at + LENGTH.size + n
            if end + CHECK.size > len(data):
                break
            lengths.append(data[at : at + 8])
            parts.append(data[at + LENGTH.size : end])
            checks.append((check, CHECK.unpack_from(data, end)[0]))
            offsets.append(base + at)
            at = end + CHECK.size
        if parts:
            found = np.stack([masked(crc32c(lengths)), masked(crc32c(parts))], 1)
            if (found != np.array(checks, np.uint32)).any():
                raise ValueError(f"{where}: a checksum does not match")
            yield parts, offsets
        left, base = data[at:], base + at
    if left:
        raise ValueError(f"{where}: {len(left)} bytes after the last whole frame")


def decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width, flags = HEADER.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=HEADER.size)
    if len(ids) != n:
        raise ValueError(f"document {doc_id}: {len(ids)} ids where the header has {n}")
    return None if flags & NULL_ID else doc_id, ids


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, shard, n_tokens in zip(*(c.to_pylist() for c in batch.columns)):
            store, at = pafs.FileSystem.from_uri(path)
            record, start = 0, 0
            with store.open_input_stream(at) as stream:
                for parts, _ in frames_of(stream, path):
                    rows = []
                    for payload in parts:
                        doc_id, ids = decode(payload)
                        rows.append((path, shard, record, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        record, start = record + 1, start + len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), *[pa.int64()] * 5))], names=[c.split()[0] for c in READ.split(", ")]
                    )
            if start != n_tokens:
                raise ValueError(f"{path}: {start} ids where the index has {n_tokens}")


def read_records(index: DataFrame, shards: int | None = None) -> DataFrame:
    """(path, shard, record, doc_id, start, n_tokens, ids_crc32) of each record, read from the files and checked.

    ``start`` counts the ids of all records before it, through all shards. A shard is read front to back by one task, a few
    megabytes at a time; what spans shards is one total per shard.
    """
    totals = index.groupBy("path", "shard").agg(F.sum("n_tokens").alias("n_tokens"))
    rows = totals.repartitionByRange(_shards(index.sparkSession, shards), "shard").mapInArrow(_read_shards, READ)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_start"))
    # one row per shard
    rows = rows.join(F.broadcast(starts), "shard")
    return rows.select("path", "shard", "record", "doc_id", (F.col("_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _read_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, file = None, None
    for batch in batches:
        rows = []
        for path, offset, length, place in zip(*(c.to_pylist() for c in batch.columns)):
            if path != name:
                store, at = pafs.FileSystem.from_uri(path)
                name, file = path, store.open_input_file(at)
            file.seek(offset)
            (parts, _), *rest = frames_of(pa.BufferReader(file.read(length)), path)
            doc_id, ids = decode(parts[0])
            rows.append((place, doc_id, ids.astype("i4")))
        if rows:
            places, ids, tokens = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=["place", "doc_id", "ids"])


def read_shuffled(index: DataFrame, seed: int, shards: int | None = None) -> DataFrame:
    """(place, doc_id, ids): every record once, dealt over the tasks in an order that depends on the seed alone.

    ``place`` is a hash; sorting by it gives the order. Within a task, records are fetched by file and offset, so that a
    file is opened once, and ``place`` restores the random order.
    """
    place = F.xxhash64(F.lit(seed), "shard", "record")
    rows = index.select("path", "offset", "length", place.alias("place")).repartitionByRange(_shards(index.sparkSession, shards), "place")
    read = rows.sortWithinPartitions("path", "offset").mapInArrow(_read_at, "place long, doc_id long, ids array<int>")
    return read.sortWithinPartitions("place")
