"""Merging of near-identical memory entries: similarity graph, components, fused entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.memory import TOXIC_CLASSES
from plumbline.operators.search import BLOCK_ROWS, DIGITS, _unit
from plumbline.session import checkpointed

# Fixed value: entries above this cosine belong together.
MERGE_COSINE = 0.80


def similarity_forest(entries: DataFrame, threshold: float = MERGE_COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the entries ``(id LONG, vec)`` linked by cosine > threshold.

    Entries are hashed into blocks and a task compares one pair of blocks. It returns a spanning
    forest of what it found, so even a block of copies yields fewer edges than entries, never all
    pairs.
    """
    rows = entries.select("id", "vec")
    n = max(1, -(-rows.count() // block_rows))
    blocked = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = blocked.select("id", "vec", F.col("_b").alias("x"), F.explode(F.sequence(F.col("_b"), F.lit(n - 1))).alias("y"))
    right = blocked.select(
        F.col("id").alias("id2"), F.col("vec").alias("vec2"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("x2"), F.col("_b").alias("y2")
    )

    def forest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"a": [], "b": []})
        pid, qid = p["id"].to_numpy(), q["id2"].to_numpy()
        near = (np.round(_unit(p["vec"]) @ _unit(q["vec2"]).T, DIGITS) > threshold) & (pid[:, None] != qid[None, :])
        seen_p, seen_q = np.zeros(len(pid), dtype=bool), np.zeros(len(qid), dtype=bool)
        a, b = [], []
        for start in np.flatnonzero(near.any(axis=1)):
            if seen_p[start]:
                continue
            seen_p[start], stack = True, [(True, start)]
            while stack:
                of_p, i = stack.pop()
                hits = np.flatnonzero((near[i] & ~seen_q) if of_p else (near[:, i] & ~seen_p))
                (seen_q if of_p else seen_p)[hits] = True
                for j in hits:
                    a.append(pid[i] if of_p else pid[j])
                    b.append(qid[j] if of_p else qid[i])
                    stack.append((not of_p, j))
        return pd.DataFrame({"a": a, "b": b}).astype("int64")

    return left.groupBy("x", "y").cogroup(right.groupBy("x2", "y2")).applyInPandas(forest, "a bigint, b bigint").filter("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` with the smallest id of each component as its label.

    Each round takes the smallest label among neighbours and then the label of that label, so
    long chains halve. The labels are checkpointed in the shared folder every round.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        offered = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        hooked = labels.join(offered, "id").select("id", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        parent = hooked.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        step = checkpointed(
            hooked.join(parent, "component", "left").select("id", "_old", F.least("component", F.coalesce("_up", "component")).alias("component"))
        )
        labels = step.select("id", "component")
        if step.filter("component <> _old").isEmpty():
            return labels


def merge_clusters(entries: DataFrame, threshold: float = MERGE_COSINE, keep_class: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fuse entries ``(id, vec, acessos, answer_class)`` linked by similarity.

    Accesses add up and ``merged_from`` counts the members. A fused entry loses its class unless
    ``keep_class``, which keeps a toxic class of any member. Lone entries pass unchanged.
    """
    components = connected_components(similarity_forest(entries, threshold, block_rows))
    placed = entries.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    toxic = F.min(F.when(F.col("answer_class").isin(*TOXIC_CLASSES), F.col("answer_class")))
    alone = F.count(F.lit(1)) == 1
    kept = F.when(alone, F.min("answer_class")).otherwise(toxic if keep_class else F.lit(None))
    return placed.groupBy(F.col("component").alias("id")).agg(
        F.sum(F.coalesce("acessos", F.lit(0))).alias("acessos"), kept.alias("answer_class"), F.count(F.lit(1)).alias("merged_from")
    )
