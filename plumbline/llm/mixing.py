"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in order, form blocks. With weight w, block j of a source (from 0) is released at slot floor(j / w)
and due by slot ceil((j + 1) / w); in each slot the released block with the earliest deadline runs. The weights are whole
units out of their sum Q, so every release and deadline moves by Q slots when j moves by a source's units: the schedule
repeats after Q slots, at which point each source has had exactly its share. One period is worked out from the weights
alone, and a document's slot follows from its rank in its source by arithmetic, in parallel.

At any slot, a source has had less than one block more or less than its weight asks for. When a source runs out, the last
period runs without it, and the others go on with their weights in the same proportion to each other (a new phase).

Sources without a weight of their own share one class. ``Divided`` units are given to each of them in equal parts: within the
slots of the class, block j of a source is released and due in round j, so blocks go in order of (j, name), one dense rank that
Spark computes for any number of sources. With S such sources a source is less than 1 - 1/S blocks off its share of the
class, and 1/S of the class's own deviation comes on top, so it, too, is less than one block off its weight. When some of them
run out, the class goes on with the others.

Defined cases: sources without a weight, a null source among them, have ``other``: a plain number is the weight of one class of
all of them in order, ``Divided`` units give each of them a weight of its own; weights are positive; ties in the order of a source
are broken by a hash of the text; repeated rows keep a place each; an empty table gives an empty result; extra columns stay,
those called like the result are replaced.
"""

from __future__ import annotations

from heapq import heappop, heappush
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import numbered, written

OTHER = "\0other"
NULL = "\0null"
MOST_UNITS = 100_000  # slots of a period, which the caller's weights add up to
MOST_SLOTS = 20 * MOST_UNITS  # slots that the table which is joined lists over all phases


class Divided(int):
    """Units that all sources without a weight have in equal parts, each as a source of its own."""


def pattern(units: dict[str, int]) -> list[str]:
    """The source of each slot of one period: the released block with the earliest deadline, by name where equal."""
    total = sum(units.values())
    if total > MOST_UNITS:
        raise ValueError(f"weights sum up to {total} units, more than {MOST_UNITS}")
    waiting = [(0, s) for s in sorted(units)]  # (release, source); a source has one block in either heap
    done, ready, slots = dict.fromkeys(units, 0), [], []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heappop(waiting)[1]
            heappush(ready, (-(-(done[s] + 1) * total // units[s]), s))
        best = heappop(ready)[1]
        slots.append(best)
        done[best] += 1
        if done[best] < units[best]:
            heappush(waiting, (done[best] * total // units[best], best))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, dict[str, int], dict[str, int]]]:
    """(first slot, units, blocks each source has had before) of the stretches in which the same sources run."""
    out, slot = [], 0
    had = dict.fromkeys(weights, 0)
    active = {s for s in weights if blocks.get(s, 0) > 0}
    while active:
        divisor = gcd(*(weights[s] for s in active))
        units = {s: weights[s] // divisor for s in active}
        out.append((slot, units, {s: had[s] for s in active}))
        # whole periods that no source falls short in, and the one in which the first runs out
        periods = min(-(-(blocks[s] - had[s]) // units[s]) for s in active)
        slot += periods * sum(units.values())
        for s in active:
            had[s] = min(blocks[s], had[s] + periods * units[s])
        active = {s for s in active if had[s] < blocks[s]}
    return out


def mixed(docs: DataFrame, weights: dict[str, int], block: int, other: int, source: str = "source", order: str = "doc_id") -> DataFrame:
    """``docs`` with block (of its source, from 0), slot, and place in its block; (slot, place) is the mixed order.

    ``weights`` are units per source, ``other`` those of all remaining sources together, as one class or ``Divided``;
    ``block`` is the number of documents in a block, the last one of a source may have fewer.
    """
    spark = docs.sparkSession
    if min([*weights.values(), other]) < 1 or block < 1:
        raise ValueError("weights and blocks are whole and positive")
    rows = docs.select(*[c for c in docs.columns if c not in ("block", "slot", "place")])
    name = F.coalesce(F.col(source).cast("string"), F.lit(NULL))
    rows = rows.withColumn("_kind", F.when(name.isin(*weights), name).otherwise(F.lit(OTHER))).withColumn("_tie", F.xxhash64(*rows.columns))
    weights = weights | {OTHER: int(other)}
    apart = isinstance(other, Divided)
    rows = rows.withColumn("_own", name if apart else F.col("_kind"))
    ranked = numbered(rows, [F.col("_kind"), F.col("_own"), F.col(order).asc_nulls_first(), F.col("_tie")], "mix", "_rank")
    sizes = {r["_kind"]: r for r in ranked.groupBy("_kind").agg(F.min("_rank").alias("first"), F.count("*").alias("n")).collect()}  # a row per weight
    blocks = {s: -(-r["n"] // block) for s, r in sizes.items()}
    if apart and OTHER in sizes:
        in_turn, blocks[OTHER] = _rounds(ranked.where(F.col("_kind") == OTHER).select("_rank", "_own"), block)
    plan = phases(blocks, weights)
    lines, listed = [], 0  # a row per source and phase, with the slots of the source's units in a period that it has blocks for
    for k, (slot, units, had) in enumerate(plan):
        later = plan[k + 1][2] if k + 1 < len(plan) else {}
        turns = pattern(units)
        places = {s: [] for s in units}
        for i, s in enumerate(turns):
            if len(places[s]) < later.get(s, blocks[s]) - had[s]:
                places[s].append(slot + i)
        for s, at in places.items():
            lines.append((s, sizes[s]["first"], had[s], later.get(s, blocks[s]), units[s], len(turns), at))
        listed += sum(map(len, places.values()))
        if listed > MOST_SLOTS:
            raise ValueError(f"{len(sizes)} sources run out one by one over more than {MOST_SLOTS} listed slots")
    spans = spark.createDataFrame(lines, "_name string, _first long, _had long, _upto long, _units long, _period long, _slots array<long>")
    place = F.col("_rank") - F.col("_first")
    if apart and OTHER in sizes:
        # the class's rows learn the turn of their block; all others have it from their rank
        named = ranked.where(F.col("_kind") != OTHER).withColumns({"_block": F.lit(None).cast("long"), "_turn": F.lit(None).cast("long"), "_at": F.lit(None).cast("long")})
        ranked = named.unionByName(ranked.where(F.col("_kind") == OTHER).join(in_turn, "_rank"))
        number, block_, at = F.coalesce("_turn", F.floor(place / block)), F.coalesce("_block", F.floor(place / block)), F.coalesce("_at", place % block)
    else:
        number, block_, at = F.floor(place / block), F.floor(place / block), place % block
    placed = ranked.join(F.broadcast(spans), (F.col("_kind") == F.col("_name")) & (number >= F.col("_had")) & (number < F.col("_upto")))
    since = number - F.col("_had")
    turn = F.get("_slots", (since % F.col("_units")).cast("int")) + F.floor(since / F.col("_units")) * F.col("_period")
    made = [block_.alias("block"), turn.alias("slot"), at.alias("place")]
    return placed.select(*[c for c in rows.columns if c not in ("_kind", "_tie", "_own")], *made)


def _rounds(ranked: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(_rank, _block, _at, _turn) of rows (_rank, _own), and the number of blocks.

    ``_turn`` is the place of a row's block in the order of (block of its source, source); only ranks and names are handled.
    """
    firsts = ranked.groupBy("_own").agg(F.min("_rank").alias("_from"))
    since = F.col("_rank") - F.col("_from")
    rows = ranked.join(firsts, "_own").select("_rank", "_own", F.floor(since / block).alias("_block"), (since % block).alias("_at"))
    turns = numbered(rows.where("_at = 0").select("_own", "_block"), [F.col("_block"), F.col("_own")], "mix-blocks", "_turn")
    turns = written(turns, "mix-turns")
    return rows.join(turns, ["_own", "_block"]).select("_rank", "_block", "_at", "_turn"), turns.count()
