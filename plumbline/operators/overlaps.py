"""How many pairs of sets share how many items: exact, and without a row for every pair that shares a common item.

Equal sets are one group with a multiplicity. An item is light while few groups hold it. Pairs that share light items are
listed inside the task that holds an item, at most half of ``LIGHT`` per item and group; whatever else such a pair shares depends
on both groups' other items.
All light items are then taken out, groups that became equal are merged, and the rest is the same problem with fewer groups
and items: one that every set held is soon held by one group. Every level adds what its listed pairs share beyond the next one.

What is left in the end are groups without an item, or groups all of whose items are in many different groups. These are
compared in blocks inside tasks by a product of incidence matrices that returns counts, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import checkpointed, row_count_within

LIGHT = 64  # groups that may hold an item whose pairs are listed
TASK_PAIRS = 1 << 22  # listed pairs that a task counts
WIDE = 32  # light items of a group that travel to each other's pairs
FEW_KINDS = 1 << 14  # kinds of groups that are sent to every task
MET = "ka long, kb long, more long, n long"
BLOCK = 2048  # groups that are compared at once
COLUMNS = 8192  # items that are multiplied at once


def _pairs(n: Column) -> Column:
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - 1) / 2).cast("decimal(38,0)")


def pair_overlaps(sets: DataFrame) -> DataFrame:
    """``k_pair, overlap, n_pairs`` over all pairs of rows of ``sets`` (items ARRAY of distinct values in order, k).

    ``k_pair`` is the smaller k of a pair.
    """
    groups = _numbered(sets.groupBy("items", F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("mult")))
    changes = []
    while True:
        single = groups.select("id", F.explode("items").alias("item"))
        degrees = checkpointed(single.groupBy("item").agg(F.count(F.lit(1)).alias("df")))
        light = degrees.filter(F.col("df") <= LIGHT)
        if light.isEmpty():
            break
        heavy = degrees.filter(F.col("df") > LIGHT).select("item")
        if not heavy.isEmpty():
            kept = single.join(heavy, "item").groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("rest"))
            groups = checkpointed(groups.join(kept, "id", "left").withColumn("rest", F.coalesce("rest", F.slice("items", 1, 0))))
        else:
            groups = groups.withColumn("rest", F.slice("items", 1, 0))
        changes.append(checkpointed(_listed(light, groups).unionByName(_merged(groups)).groupBy("k", "x").agg(_total("n"))))
        groups = _numbered(groups.groupBy(F.col("rest").alias("items"), "k").agg(F.sum("mult").alias("mult")))
    total = _compared(groups)
    for change in changes:
        total = total.unionByName(change)
    return total.groupBy("k", "x").agg(_total("n")).filter("n <> 0").select(F.col("k").alias("k_pair"), F.col("x").alias("overlap"), F.col("n").alias("n_pairs"))


def _total(column: str) -> Column:
    return F.sum(column).cast("decimal(38,0)").alias(column)


def _numbered(groups: DataFrame) -> DataFrame:
    return checkpointed(groups.withColumn("id", F.monotonically_increasing_id()))


def _moves(pairs: DataFrame) -> DataFrame:
    """``pairs`` (k, was, is, n) as changes of the counts at both overlaps."""
    both = F.array(F.struct(F.col("was").cast("long").alias("x"), (-F.col("n")).alias("n")), F.struct(F.col("is").cast("long").alias("x"), F.col("n").alias("n")))
    return pairs.filter("was <> is").select("k", F.explode(both).alias("m")).select("k", "m.x", F.col("m.n").cast("decimal(38,0)").alias("n"))


def _merged(groups: DataFrame) -> DataFrame:
    """Pairs of equal sets share all their items; without the light ones they would share the rest."""
    return _moves(groups.filter("mult > 1").select("k", F.size("rest").alias("was"), F.size("items").alias("is"), _pairs(F.col("mult")).alias("n")))


def _listed(light: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of groups that share light items.

    All that decides a pair's place, k, mult and rest, is a kind, so pairs leave their task as counts per two kinds. A group goes
    once to each of its light items, with those after it. Pairs of an item that share r later ones are as many as pairs that
    share more than r items in all, so no pair has to leave its item to be counted once. Groups of more than ``WIDE`` light
    items, whose later ones would be many, are paired by lists of ids instead.
    """
    kinds = checkpointed(groups.groupBy("k", "mult", "rest").agg(F.min("id").alias("kind")))
    one, two = groups.alias("g"), (F.broadcast(kinds) if row_count_within(kinds, FEW_KINDS) else kinds).alias("h")
    of = one.join(two, F.col("g.k").eqNullSafe(F.col("h.k")) & (F.col("g.mult") == F.col("h.mult")) & (F.col("g.rest") == F.col("h.rest")))
    of = of.select(F.array_except("g.items", "g.rest").alias("items"), "id", "kind").withColumn("narrow", F.size("items") <= WIDE)
    pairs = light.agg(F.sum(F.col("df") * (F.col("df") - 1) / 2).alias("n")).first().n or 0
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.sparkSession.sparkContext.defaultParallelism, int(pairs) // TASK_PAIRS)
    each = of.filter("narrow").select("kind", "items", F.posexplode("items").alias("at", "item"))
    each = each.select("item", "kind", F.slice("items", F.col("at") + 2, F.size("items")).alias("later"))
    met = each.repartition(parts, "item").sortWithinPartitions("item").mapInArrow(_met_blocks, MET)
    if groups.agg(F.max(F.size("items") - F.size("rest")).alias("most")).first().most > WIDE:
        member = of.select(F.struct("narrow", "id", "kind").alias("m"), F.explode("items").alias("item"))
        held = member.groupBy("item").agg(F.sort_array(F.collect_list("m")).alias("all"), F.count_if(~F.col("m.narrow")).cast("int").alias("wide"))
        held = held.filter((F.col("wide") > 0) & (F.size("all") > 1))
        later = held.select("all", F.explode(F.sequence(F.lit(1), F.least(F.col("wide"), F.size("all") - 1))).alias("i")).select(
            F.col("all")[F.col("i") - 1].alias("x"), F.slice("all", F.col("i") + 1, F.size("all")).alias("y")
        )
        lists = later.select(F.col("x.id").alias("a"), F.col("x.kind").alias("ka"), F.col("y.id").alias("b"), F.col("y.kind").alias("kb"))
        met = met.unionByName(lists.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_met, MET))
    counts = met.groupBy("ka", "kb", "more").agg(F.sum("n").alias("n"))
    for side in "ab":
        counts = counts.join(kinds.select(F.col("kind").alias(f"k{side}"), F.struct("k", "mult", "rest").alias(side)), f"k{side}")
    was = F.size(F.array_intersect("a.rest", "b.rest"))
    times = (F.col("a.mult").cast("decimal(19,0)") * F.col("b.mult").cast("decimal(19,0)")).cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)")
    return _moves(counts.select(F.least("a.k", "b.k").alias("k"), was.alias("was"), (was + F.col("more")).alias("is"), times.cast("decimal(38,0)").alias("n")))


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of both rows of every pair within runs of so many rows, and where the pairs of each first row begin."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - np.arange(len(ends)) - 1
    begin = np.cumsum(after) - after
    first = np.repeat(np.arange(len(ends)), after)
    return first, first + 1 + np.arange(len(first)) - begin[first], begin


def _runs(keys: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal neighbours."""
    return np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))


def _met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs of groups of two kinds share how many items, as changes; rows (item, kind, later) come in the order of item."""

    def told(rows: pa.Table, codes: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        sizes = _runs(codes[:n])
        first, second, begin = _pairs_within(sizes)
        shared = np.zeros(len(first), np.int64)
        # Rows of one block with the same later item are the pairs that share it.
        times = pc.list_value_length(rows["later"]).to_numpy()
        row = np.repeat(np.arange(n), times)
        keys = np.repeat(np.arange(len(sizes)), sizes)[row] * (int(codes.max()) + 1) + codes[n:]
        order = np.argsort(keys, kind="stable")
        x, y, _ = _pairs_within(_runs(keys[order]) if len(keys) else np.zeros(0, np.int64))
        x, y = row[order][x], row[order][y]
        np.add.at(shared, begin[x] + y - x - 1, 1)
        kinds, kind = np.unique(rows["kind"].to_numpy(), return_inverse=True)
        low, high, wide = np.minimum(kind[first], kind[second]), np.maximum(kind[first], kind[second]), int(shared.max(initial=0)) + 1
        found, times = np.unique((low * len(kinds) + high) * wide + shared, return_counts=True)
        more, both = found % wide, found // wide
        ka, kb, again = kinds[both // len(kinds)], kinds[both % len(kinds)], more > 0
        columns = (ka, ka[again]), (kb, kb[again]), (more + 1, more[again]), (times, -times[again])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["ka", "kb", "more", "n"])

    open_ = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if open_ is None else pa.concat_tables([open_, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        codes = _codes(rows)
        # The last item's block may go on in the next batch.
        end = rows.num_rows - _runs(codes[: rows.num_rows])[-1]
        if end:
            yield told(cut := rows.slice(0, end), _codes(cut))
        open_ = rows.slice(end)
    if open_ is not None:
        yield told(open_, _codes(open_))


def _codes(rows: pa.Table) -> np.ndarray:
    """Numbers of the items of ``rows``, then of all their later ones."""
    item, later = (rows[c].combine_chunks() for c in ("item", "later"))
    return pa.concat_arrays([item, later.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs of groups of two kinds share how many items; rows (a, ka, b, kb) come in the order of a."""

    def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        return [k[starts] for k in keys], np.add.reduceat(n[order], starts)

    def told(keys: list[np.ndarray], more: np.ndarray) -> pa.RecordBatch:
        kinds, n = summed([keys[2], keys[3], more], np.ones(len(more), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*kinds, n)], names=["ka", "kb", "more", "n"])

    open_ = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        if not batch.num_rows:
            continue
        a, ka = (batch.column(c).to_numpy() for c in ("a", "ka"))
        times = pc.list_value_length(batch.column("b")).to_numpy()
        b, kb = (batch.column(c).flatten().to_numpy() for c in ("b", "kb"))
        rows = [np.repeat(a, times), b, np.repeat(ka, times), kb, np.ones(len(b), np.int64)]
        *keys, more = (np.concatenate(x) for x in zip(open_, rows))
        keys, more = summed(keys, more)
        # The last group's list may go on in the next batch.
        end = np.searchsorted(keys[0], a[-1])
        if end:
            yield told([k[:end] for k in keys], more[:end])
        open_ = [*(k[end:] for k in keys), more[end:]]
    if len(open_[0]):
        yield told(open_[:4], open_[4])


def _compared(groups: DataFrame) -> DataFrame:
    """Counts over all pairs of groups, and of equal sets within them, block by block."""
    blocks = max(1, -(-groups.count() // BLOCK))
    placed = groups.select("id", "items", "k", "mult", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    left = placed.select("*", F.explode(F.sequence("block", F.lit(blocks - 1))).alias("other"))
    right = placed.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("other"))

    def compare(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], int] = {}
        if len(p) and len(q):
            shared = _products(p["items"], q["items"])
            kp, kq, mult = p["k"].to_numpy(), q["k"].to_numpy(), q["mult"].to_numpy()
            ids, own = q["id"].to_numpy(), p["id"].to_numpy()
            wide = int(shared.max(initial=0)) + 1
            for i, times in enumerate(p["mult"].tolist()):
                later = ids > own[i] if key[0] == key[1] else slice(None)
                codes, place = np.unique(np.minimum(kp[i], kq[later]) * wide + shared[i][later], return_inverse=True)
                sums = np.zeros(len(codes), np.int64)
                np.add.at(sums, place, mult[later])
                for code, n in zip(codes.tolist(), sums.tolist()):
                    found[code // wide, code % wide] = found.get((code // wide, code % wide), 0) + times * n
            if key[0] == key[1]:
                for k, items, times in zip(kp.tolist(), p["items"], p["mult"].tolist()):
                    found[k, len(items)] = found.get((k, len(items)), 0) + times * (times - 1) // 2
        return pd.DataFrame([(k, x, str(n)) for (k, x), n in found.items() if n], columns=["k", "x", "n"])

    counts = left.groupBy("block", "other").cogroup(right.groupBy("other", "block")).applyInPandas(compare, "k long, x long, n string")
    return counts.groupBy("k", "x").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("decimal(38,0)").alias("n"))


def _products(p: pd.Series, q: pd.Series) -> np.ndarray:
    """The number of items that each set of ``p`` shares with each of ``q``."""
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (p, q)]
    flat = [[item for x in s for item in x] for s in (p, q)]
    index = {item: i for i, item in enumerate(dict.fromkeys(flat[0] + flat[1]))}
    cols = [np.fromiter((index[x] for x in f), np.int64, len(f)) for f in flat]
    out = np.zeros((len(p), len(q)), np.int64)
    for start in range(0, len(index), COLUMNS):
        made = []
        for s, r, c in zip((p, q), rows, cols):
            here = (c >= start) & (c < start + COLUMNS)
            m = np.zeros((len(s), min(COLUMNS, len(index) - start)), np.float32)
            m[r[here], c[here] - start] = 1
            made.append(m)
        out += (made[0] @ made[1].T).astype(np.int64)
    return out
