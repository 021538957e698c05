"""N-gram Jaccard join: documents linked by 100 * |A and B| >= 80 * |A or B| over their sets of word shingles.

The document by n-gram incidence matrix A is never multiplied out whole. Rows with equal sets are one class. Of each class
only the columns that a link cannot do without are laid out (with columns ordered from rare to common, the first
n - ceil(0.8 n) + 1 of n), so the product A * A' runs over short columns. It is taken in blocks:

1. Columns of few classes are multiplied out, and overlap counts add up over them. A linked pair of sizes a <= b has at least
   ceil(0.8 / 1.8 (a + b)) - ceil(0.8 b) + 1 of the laid out columns in common, so pairs that stay below (with all long columns
   of either counted as common) are discarded; the others are compared exactly.
2. In every long column a few classes, chosen by hash, are multiplied with the others, and exact overlaps make components. A
   coherent group of copies is joined here in a number of products that grows with its size, not its square. This is repeated
   with other classes as long as it joins much.
3. Long columns that still hold several components are multiplied block by block between components. A pair lives on only if
   its sizes and its places in the column leave room for the overlap that its sizes ask for, and if parity sketches of both
   sets do not show too many differences (they never show more than there are); survivors are compared exactly.

The order of columns comes from a count of all shingles of all documents in a fixed number of cells (counts only ever too
high). Any order gives the same links; a good one makes columns short.

Defined cases: a null text, or one without words, has an empty set and no link; with fewer words than a shingle, the whole
sequence is the one shingle; repeated rows are copies of each other; a null doc_id takes part, and a component's id is the
least doc_id that is not null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import SLICE, batches_of, components, given_back, remove, shared_folder, utf8, written

SHINGLE = 5
CELLS = 1 << 22
CELL_BLOCK = 1 << 16
HOT = 64  # columns that may hold more classes are never collected whole
SHORT = 9  # columns of no more classes are multiplied out
HUBS = 8  # classes of a long column that meet all others in one round
MARKS = 1 << 26  # bits that tell whose sets are made again for an exact comparison
MARK_BLOCKS = 16
BLOCK = 128  # classes of a long column that are collected together
BATCH = 1024  # rows of an Arrow batch; a row may hold two sets
SKETCH = 1 << 16  # bits of the longest sketch
PERCENT = 80

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _step(each, *args):
    return partial(_run, each, args)


def _run(each, args, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from given_back(each(*args, batches))


class Shingler:
    """Sets of whole texts: the sorted distinct 64-bit hashes of their word shingles."""

    def __init__(self, size: int = SHINGLE, cache: int = 100_000):
        self.size, self.most = size, cache
        self.words = _Hashes()
        self.factors = np.resize(_FACTORS, size) * (2 * np.arange(size, dtype=np.uint64) + np.uint64(1))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # both know ASCII alone
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.most:
            self.words.clear()
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(w) - self.size + 1
        h = w[:n] * self.factors[0]
        for k in range(1, self.size):
            h += w[k : k + n] * self.factors[k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(29)
        return np.unique(h)


class _Hashes(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def needed(n: int) -> int:
    """Elements of a set of n that any linked set holds."""
    return -(-PERCENT * n // 100)


MEMBER = "doc_id long, text_key long, n long, signature binary, block int, cells binary"


def _members(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end the counts of all shingles of the task, a row per block of cells."""
    sets, cells = Shingler(size), np.zeros(CELLS, np.uint32)
    names = [c.split()[0] for c in MEMBER.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            rows = [sets(t) for t in utf8(part.column(2))]
            if rows and (found := np.concatenate(rows)).size:
                np.add.at(cells, found & np.uint64(CELLS - 1), np.uint32(1))
            signs = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in rows], pa.binary())
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in rows], pa.int64()), signs, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names
            )
    for block in range(CELLS // CELL_BLOCK):
        own = cells[block * CELL_BLOCK : (block + 1) * CELL_BLOCK]
        if own.any():
            nulls = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_task()], pa.int64()), *nulls[1:], pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=names)


def _task() -> int:
    return TaskContext.get().partitionId()


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(cells, np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["block", "cells"])


def _levels(counts: DataFrame) -> np.ndarray:
    """Of each cell, the number of binary digits of its count. Tables of cells are added in tasks, in two rounds."""
    spark, kind = counts.sparkSession, "block int, cells binary"
    salted = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", F.pmod("doc_id", F.lit(16)))
    sums = salted.select("block", "cells").mapInArrow(_sum_cells, kind).repartition(CELLS // CELL_BLOCK, "block").mapInArrow(_sum_cells, kind)
    total = np.zeros(CELLS, np.uint32)
    for row in sums.toLocalIterator():
        total[row.block * CELL_BLOCK : (row.block + 1) * CELL_BLOCK] += np.frombuffer(row.cells, np.uint32)
    return np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements by their high bits, four bits or more per element, as 64-bit words.

    Two sketches differ in no more bits than their sets in elements, also after both are folded to the same length.
    """
    width = int(min(max(512, 1 << (4 * len(s) - 1).bit_length()), SKETCH)) if len(s) else 512
    odd = np.bincount((s >> np.uint64(44)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _prefixes(size: int, levels, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, level = Shingler(size), levels.value
    hot = int(np.log2(HOT))
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            columns, light, sketches = [], [], []
            for text in utf8(part.column(2)):
                s = sets(text)
                own = level[s & np.uint64(CELLS - 1)]
                first = np.lexsort((s, own))[: len(s) - needed(len(s)) + 1]
                columns.append(s[first].view(np.int64))
                light.append(int((own[first] <= hot).sum()))
                sketches.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(light, pa.int32()), pa.array(columns, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_key", "light", "columns", "sketch"],
            )


def _sets(size: int, marks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the documents whose keys are marked."""
    sets, bits = Shingler(size), marks.value
    for batch in batches:
        at = batch.column(2).to_numpy().view(np.uint64) & np.uint64(MARKS - 1)
        part = batch.take(pa.array(np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)))
        rows = [sets(t).tobytes() for t in utf8(part.column(3))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "text_key", "elements"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(MARKS // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(MARKS - 1)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    for block, own in enumerate(bits.reshape(MARK_BLOCKS, -1)):
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "bits"])


def _join_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            joined[block] = joined.get(block, np.uint8(0)) | np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(joined), pa.int32()), pa.array([b.tobytes() for b in joined.values()], pa.binary())], names=["block", "bits"])


def _marked(keys: DataFrame) -> np.ndarray:
    """A bit for every value that some key has in its low bits: of a fixed size, so it only ever lets too many through."""
    kind = "block int, bits binary"
    rows = keys.mapInArrow(_step(_mark), kind).repartition(MARK_BLOCKS, "block").mapInArrow(_join_marks, kind)
    bits = np.zeros((MARK_BLOCKS, MARKS // MARK_BLOCKS // 8), np.uint8)
    for row in rows.toLocalIterator():
        bits[row.block] |= np.frombuffer(row.bits, np.uint8)
    return bits.reshape(-1)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            linked.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _room(na, pa_, nb, pb):
    """Whether sizes and places leave room for the overlap that a link needs, if this column is the first that both hold."""
    asked = F.ceil(F.lit(PERCENT) * (na + nb) / F.lit(100 + PERCENT))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) >= asked)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of different components, from two blocks of one column, that have room for a link.

    A link leaves a ninth of both sizes for what only one set holds; sketches that differ in more bits rule it out. So a group
    whose members are linked with one text, but not with each other, writes few of its pairs.
    """
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = (np.array([(e["id"], e["n"], e["place"], e["label"]) for e in side], np.int64).reshape(-1, 4).T for side in (left, right))
            n, m = x[1][:, None], y[1][None, :]
            room = np.minimum(n - x[2][:, None], m - y[2][None, :]) * (100 + PERCENT) >= PERCENT * (n + m)
            room &= 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
            room &= (x[3][:, None] != y[3][None, :]) & (x[0][:, None] != y[0][None, :])
            if room.any():
                _apart([e["sketch"] for e in left], [e["sketch"] for e in right], x[1], y[1], room)
            i, j = np.nonzero(room)
            if len(i):
                a, b = x[0][i], y[0][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _apart(left: list[bytes], right: list[bytes], n: np.ndarray, m: np.ndarray, room: np.ndarray) -> None:
    """Takes pairs out of ``room`` whose sketches differ in more bits than a link allows their sets in elements."""
    by_length: dict[int, list[int]] = {}
    for j, r in enumerate(right):
        by_length.setdefault(len(r), []).append(j)
    stacked = {size: (np.array(at), np.stack([np.frombuffer(right[j], np.uint64) for j in at])) for size, at in by_length.items()}
    for i in np.flatnonzero(room.any(axis=1)):
        own = np.frombuffer(left[i], np.uint64)
        for at, others in stacked.values():
            words = min(len(own), others.shape[1])
            differ = np.bitwise_count(folded(own, words) ^ folded(others, words)).sum(axis=1, dtype=np.int64)
            room[i, at] &= differ * (100 + PERCENT) <= (100 - PERCENT) * (n[i] + m[at])


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, and ``first``: it is the one of its component to keep.

    ``text_key`` is the 64-bit hash of the text; documents with an empty set are all first, with their own doc_id.
    """
    with batches_of(docs.sparkSession, BATCH):
        return _near_duplicates(docs, size)


def _near_duplicates(docs: DataFrame, size: int) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_folder(spark, "jaccard")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = written(source.mapInArrow(_step(_members, size), MEMBER), "", f"{folder}/members")
    members = rows.where("block IS NULL").select("doc_id", "text_key", "n", "signature")
    levels = spark.sparkContext.broadcast(_levels(rows.where("block IS NOT NULL").select("doc_id", "block", "cells")))
    # one document stands for all with the same set, one with an id where there is one
    classes = members.where("n > 0").groupBy("signature").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("who"), F.first("n").alias("n"))
    classes = written(classes.select("signature", "n", F.col("who.doc_id").alias("doc_id"), F.col("who.text_key").alias("text_key"), F.monotonically_increasing_id().alias("id")), "", f"{folder}/classes")
    stands = classes.select("id", "n", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    prefixes = source.mapInArrow(_step(_prefixes, size, levels), "doc_id long, text_key long, light int, columns array<long>, sketch binary")
    prefixes = prefixes.join(stands, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    prefixes = written(prefixes.select("id", "n", "light", "columns", "sketch"), "", f"{folder}/prefixes")
    levels.destroy()  # nothing reads the texts by it again
    cells = prefixes.select("id", "n", "light", F.posexplode("columns").alias("place", "h"))
    cells = cells.select("h", F.struct((F.col("n") * (1 << 31) + F.col("place")).alias("sized"), "id").alias("e"), (F.col("place") < F.col("light")).alias("light"))
    # light columns hold at most HOT rows, as the counts of cells are never too low
    light = cells.where("light").groupBy("h").agg(F.collect_list("e").alias("all")).where(F.size("all") > 1)
    light = written(light, "", f"{folder}/light")
    hot = cells.where("NOT light").select("h", "e")
    many = written(hot.groupBy("h").agg(F.count("*").alias("d")).where("d > 1"), "", f"{folder}/hot-sizes")
    few = hot.join(many.where(F.col("d") <= SHORT), "h").groupBy("h").agg(F.collect_list("e").alias("all"))
    short = light.where(F.size("all") <= SHORT).unionAll(few)
    long = light.where(F.size("all") > SHORT).select("h", F.explode("all").alias("e"), F.size("all").cast("long").alias("d"))
    long = long.unionAll(hot.join(many.where(F.col("d") > SHORT), "h").select("h", "e", "d"))
    long = written(long.select("h", "e.id", "e.sized", "d"), "", f"{folder}/long")
    checked = _verified(_counted(short, long).unionAll(_hub_pairs(long, None, 0)).distinct(), source, stands, size, f"{folder}/round0")
    labels, mixed, before = None, None, None
    for step in range(1, 1 << 20):
        labels = written(_labels(checked), "", f"{folder}/labels{step}")
        rest = long.join(labels, "id", "left").select("h", "id", "sized", F.coalesce("label", "id").alias("label"))
        rest = written(rest, "", f"{folder}/rest{step}")
        mixed = rest.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("d")).where("lo <> hi").select("h", "d")
        mixed = written(mixed, "", f"{folder}/mixed{step}")
        rest = rest.join(mixed, "h")
        apart = 0 if mixed.isEmpty() else rest.select("h", "label").distinct().count()  # what there is to join, by column
        if not apart or before and apart > before // 2:
            break
        before = apart
        pairs = _hub_pairs(rest, "label", step).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        more = _verified(pairs, source, stands, size, f"{folder}/round{step}")
        checked = written(checked.unionAll(more), "", f"{folder}/checked{step}")
    if apart:
        more = _across(rest.join(prefixes.select("id", "sketch"), "id"), checked, source, stands, size, folder)
        if not more.where("linked").isEmpty():
            labels = written(_labels(checked.unionAll(more)), "", f"{folder}/labels")
    named = classes.join(labels.withColumnRenamed("label", "component"), "id", "left").select("signature", F.coalesce("component", "id").alias("component"), F.struct("doc_id", "text_key").alias("who"), "doc_id")
    named = written(named, "", f"{folder}/named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.col("who"))).alias("best"), F.min("who").alias("any"))
    least = least.select("component", "component_id", F.coalesce("best", "any").alias("keeper"))
    named = named.select("signature", "component").join(written(least, "", f"{folder}/least"), "component")
    out = members.join(named, "signature", "left")
    first = F.struct("doc_id", "text_key").eqNullSafe(F.col("keeper")) | F.col("signature").isNull()
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), first.alias("first"))


def _across(rest: DataFrame, checked: DataFrame, source: DataFrame, stands: DataFrame, size: int, folder: str) -> DataFrame:
    """Verified pairs of long columns between components that no hub has joined, block by block."""
    parts = F.ceil(F.col("d") / BLOCK).cast("int")
    blocks = rest.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int"))
    entry = F.struct("id", _size("sized").alias("n"), _place("sized").alias("place"), "label", "sketch")
    blocks = written(blocks.groupBy("h", "part", "parts").agg(F.collect_list(entry).alias("own")), "", f"{folder}/blocks")
    left = blocks.select("h", F.col("part").alias("i"), "own", F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    right = blocks.select("h", F.col("part").alias("j"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), "part")).alias("i"))
    pairs = left.join(right, ["h", "i", "j"]).select("own", "other").mapInArrow(_step(_between), "a long, b long").distinct()
    pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    return _verified(pairs, source, stands, size, f"{folder}/last")


def _size(sized: str) -> Column:
    return F.shiftright(F.col(sized), 31)


def _place(sized: str) -> Column:
    return F.col(sized).bitwiseAND((1 << 31) - 1)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]


def _counted(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of classes that short columns, and long ones if all are common, may bring to the number of columns a link needs."""
    pairs = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: y.id > x.id), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    small, large = F.least(_size("p.x.sized"), _size("p.y.sized")), F.greatest(_size("p.x.sized"), _size("p.y.sized"))
    met = short.select(F.explode(pairs).alias("p")).where(100 * small >= PERCENT * large)
    asked = F.ceil(F.lit(PERCENT) * (small + large) / F.lit(100 + PERCENT)) - F.ceil(F.lit(PERCENT) * large / F.lit(100)) + 1
    sums = met.groupBy(F.col("p.x.id").alias("a"), F.col("p.y.id").alias("b")).agg(F.count("*").alias("common"), F.first(asked).alias("asked"))
    in_long = written(long.groupBy("id").agg(F.count("*").alias("k")), "jaccard-long")
    sums = sums.join(in_long.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a", "left").join(in_long.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b", "left")
    return sums.where(F.col("common") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) >= F.col("asked")).select("a", "b")


def _hub_pairs(long: DataFrame, label: str | None, seed: int) -> DataFrame:
    """Pairs of the hubs of each long column with its other classes (of other components), where sizes and places leave room."""
    drawn = F.xxhash64(F.lit(seed), "id")
    bucket = F.pmod(drawn, F.lit(HUBS))
    entry = F.struct(drawn.alias("drawn"), "id", "sized", *([F.col(label).alias("label")] if label else []))
    hubs = long.groupBy("h", bucket.alias("bucket")).agg(F.min(entry).alias("hub")).groupBy("h").agg(F.collect_list("hub").alias("hubs"))
    hubs = written(hubs, "jaccard-hubs")
    met = long.withColumn("y", F.struct("id", "sized")).join(hubs, "h").select("y", *([label] if label else []), F.explode("hubs").alias("x"))
    met = met.where(F.col("x.id") != F.col("y.id"))
    if label:
        met = met.where(F.col("x.label") != F.col(label))
    return met.where(_room(_size("x.sized"), _place("x.sized"), _size("y.sized"), _place("y.sized"))).select(*_pair("x", "y")).distinct()


def _labels(checked: DataFrame) -> DataFrame:
    return components(checked.where("linked"), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("label"))


def _row_key(doc_id: str, text_key: str) -> Column:
    return F.xxhash64(doc_id, text_key).alias("row_key")


def _verified(pairs: DataFrame, source: DataFrame, stands: DataFrame, size: int, folder: str) -> DataFrame:
    """(a, b, linked) of each pair of classes by their exact overlap; sets are made again for the classes in question only."""
    pairs = written(pairs, "", f"{folder}-pairs")
    if pairs.isEmpty():
        return pairs.withColumn("linked", F.lit(False))
    wanted = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct().join(stands, "id"), "", f"{folder}-wanted")
    marks = pairs.sparkSession.sparkContext.broadcast(_marked(wanted.select(_row_key("_doc", "_key"))))
    keyed = source.select("doc_id", "text_key", _row_key("doc_id", "text_key"), "text")
    sets = keyed.mapInArrow(_step(_sets, size, marks), "doc_id long, text_key long, elements binary")
    sets = sets.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "elements")
    sets = written(sets.dropDuplicates(["id"]), "", f"{folder}-sets")
    marks.destroy()
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    out = written(both.select("a", "b", "x", "y").mapInArrow(_step(_overlaps), "a long, b long, linked boolean"), "", folder)
    remove(pairs.sparkSession, f"{folder}-sets")
    return out
