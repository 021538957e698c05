"""Retrieval as batch jobs: cosine and BM25 top-k, fusion, diversification, repetition, specificity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import checkpointed, row_count_within

# Fusion and diversification constants, turn filter, similarity levels.
RRF_K, HYBRID_ALPHA, MMR_LAMBDA = 60, 0.5, 0.5
MIN_WORDS, MAX_CHARS = 5, 2000
LEVELS = (0.80, 0.85, 0.90)
BM25_K1, BM25_B = 1.5, 0.75
# Query vectors up to this number travel to every task; 4096 x 384 doubles are 12 MB.
BROADCAST_QUERIES = 4096
BLOCK_ROWS = 4096
# Beyond that, a task holds up to this many numbers of either side; a side has at least so many parts.
CELL_NUMBERS, CELL_PARTS = 1 << 22, 6
# Terms of the queries that are sent to a task at one time.
QUERY_TERMS = 1_000_000
# Scores of queries and texts that a task holds at one time.
SCORES = 1 << 20
DIGITS = 9


def cosine(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def dot(u: Column, v: Column) -> Column:
        parts = F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(parts, F.lit(0.0), lambda acc, t: acc + t)

    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's best k scores; equal scores go to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    held = rows[order]
    return order[np.arange(len(held)) - np.searchsorted(held, held) < k]


def _local_best(sims: np.ndarray, ids: np.ndarray, k: int, min_score: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of each row's best k scores; equal scores go to the smaller id."""
    kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
    rows, cols = np.nonzero((sims >= kth[:, None]) & (sims >= min_score))
    first = _first(rows, sims[rows, cols], ids[cols], k)
    return rows[first], cols[first]


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int, min_score: float = -1.0, exclude_self: bool = False,
    broadcast_queries: int = BROADCAST_QUERIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact ``(seq, id, score, pos)`` of the ``k`` nearest corpus rows ``(id, vec)`` per query ``(seq, vec)``.

    Up to ``broadcast_queries`` query vectors are sent to every task and the corpus is scanned
    once where it lies. More queries are cut into parts, as is the corpus, and each pair of parts is one task, which scores
    ``block_rows`` queries at a time. A side has ``CELL_PARTS`` parts, more only where a part would pass ``CELL_NUMBERS``, so
    the vectors are shuffled a fixed number of times. Both ways keep the best k per query inside a task, so the results'
    shuffle carries k rows per query and task.
    """
    q, c = queries.select("seq", "vec"), corpus.select("id", "vec")
    id_type = c.schema["id"].dataType.simpleString()
    schema = f"seq bigint, id {id_type}, score double"

    def near(qids: np.ndarray, qm: np.ndarray, cids: np.ndarray, cm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sims = np.round(qm @ cm.T, DIGITS)
        if exclude_self:
            sims[qids[:, None] == cids[None, :]] = -2.0
        r, j = _local_best(sims, cids, k, max(min_score, -1.0))
        return r, j, sims[r, j]

    if row_count_within(q, broadcast_queries):
        rows = q.toPandas()
        if rows.empty:
            return q.sparkSession.createDataFrame([], schema + ", pos int")
        shared = q.sparkSession.sparkContext.broadcast((rows["seq"].to_numpy(), _unit(rows["vec"])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, qm = shared.value
            held: pd.DataFrame | None = None
            for batch in batches:
                if batch.empty:
                    continue
                cids = batch["id"].to_numpy()
                r, j, x = near(qids, qm, cids, _unit(batch["vec"]))
                new = pd.DataFrame({"seq": qids[r], "id": cids[j], "score": x})
                both = new if held is None else pd.concat([held, new])
                both = both.sort_values(["seq", "score", "id"], ascending=[True, False, True])
                held = both.groupby("seq", sort=False).head(k)
            if held is not None:
                yield held

        local = c.mapInPandas(scan, schema)
    else:
        nq, nc = (_parts(side, block_rows) for side in (q, c))
        # Hash cells; each holds one part of either side.
        left = q.select("*", F.pmod(F.xxhash64("seq"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
        right = c.select("*", F.pmod(F.xxhash64("id"), F.lit(nc)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

        def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"seq": [], "id": [], "score": []})
            qids, qm, cids, cm = a["seq"].to_numpy(), _unit(a["vec"]), b["id"].to_numpy(), _unit(b["vec"])
            kept = [pd.DataFrame({"seq": qids[:0], "id": cids[:0], "score": np.zeros(0)})]
            for i in range(0, len(qm), block_rows):
                some = slice(i, i + block_rows)
                found = [(r, j + at, x) for at in range(0, len(cm), BLOCK_ROWS) for r, j, x in [near(qids[some], qm[some], cids[at : at + BLOCK_ROWS], cm[at : at + BLOCK_ROWS])]]
                r, j, x = (np.concatenate(parts) for parts in zip(*found))
                first = _first(r, x, cids[j], k)
                kept.append(pd.DataFrame({"seq": qids[some][r[first]], "id": cids[j[first]], "score": x[first]}))
            return pd.concat(kept)

        keys = [F.col("qb").cast("long"), F.col("cb").cast("long")]
        local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)
    w = Window.partitionBy("seq").orderBy(F.desc("score"), "id")
    return local.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def _parts(side: DataFrame, block_rows: int) -> int:
    """Parts of one side of a search: ``CELL_PARTS``, fewer for fewer blocks, more where they would be too large for a task."""
    size = side.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    return max(1, min(CELL_PARTS, -(-size.n // block_rows)), -(-size.n * size.width // CELL_NUMBERS))


def _terms(df: DataFrame, key: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^0-9\p{L}]+"), lambda t: t != "")
    return df.select(key, words.alias("words"))


def bm25_topk(
    queries: DataFrame, corpus: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B, query_terms: int = QUERY_TERMS
) -> DataFrame:
    """``(seq, id, bm25, pos)`` of the best ``k`` texts ``(id, text)`` per query ``(seq, text)``.

    Only corpus terms that occur in some query are counted, as combinable aggregates. A text then
    meets the queries inside its task, which keeps the best k per query, so a common term never
    becomes a row per query and text. Queries travel in parts of about ``query_terms`` terms, one
    pass over the weighted terms each.
    """
    spark = queries.sparkSession
    wanted = _terms(queries, "seq").select("seq", F.explode(F.array_distinct("words")).alias("term"))
    vocabulary = wanted.select("term").distinct()
    docs = _terms(corpus, "id").withColumn("n_words", F.size("words"))
    totals = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_words").alias("avg_words"))
    tf = (
        docs.select("id", "n_words", F.explode("words").alias("term"))
        .join(vocabulary, "term", "left_semi")
        .groupBy("id", "n_words", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, "term").crossJoin(totals)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_words") / F.col("avg_words")))
    held = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", gain.alias("g")))).alias("terms"))
    parts = 1 + wanted.count() // query_terms
    if parts > 1:
        held = checkpointed(held)
    schema = f"seq {queries.schema['seq'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, bm25 double"
    arrow = pa.schema([("seq", to_arrow_type(queries.schema["seq"].dataType)), ("id", to_arrow_type(corpus.schema["id"].dataType)), ("bm25", pa.float64())])
    found = None
    for part in range(parts):
        asked = wanted.filter(F.pmod(F.xxhash64("seq"), F.lit(parts)) == part).groupBy("seq").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        index = spark.sparkContext.broadcast([(r.seq, r.terms) for r in asked.collect()])
        best = held.mapInArrow(partial(_bm25_best, index, k, arrow), schema)
        found = best if found is None else found.unionByName(best)
    w = Window.partitionBy("seq").orderBy(F.desc("bm25"), "id")
    return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def _bm25_best(index, k: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best k texts of each query among the texts of one task.

    Terms become places in the queries' vocabulary while they are Arrow columns, so a text's terms are never objects.
    """
    seqs = np.array([seq for seq, _ in index.value])
    asks: dict[str, list[int]] = {}
    for i, (_, terms) in enumerate(index.value):
        for term in terms:
            asks.setdefault(term, []).append(i)
    known, rows_of = pa.array(list(asks), pa.string()), [np.array(i, np.int32) for i in asks.values()]
    asks.clear()
    step = max(1, min(256, SCORES // max(1, len(seqs))))
    held: pd.DataFrame | None = None
    for batch in batches:
        for start in range(0, batch.num_rows if len(seqs) else 0, step):
            some = batch.slice(start, step)
            ids, terms = some.column("id").to_pandas().to_numpy(), some.column("terms")
            flat = terms.flatten()
            place = pc.fill_null(pc.index_in(pc.struct_field(flat, "term"), value_set=known), -1).to_numpy(zero_copy_only=False)
            gain = pc.struct_field(flat, "g").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            scores = np.zeros((len(seqs), len(ids)))
            for t in np.flatnonzero(place >= 0):
                scores[rows_of[place[t]], text[t]] += gain[t]
            scores = np.round(scores, DIGITS)
            r, c = _local_best(np.where(scores > 0, scores, -np.inf), ids, k, 0.0)
            new = pd.DataFrame({"seq": seqs[r], "id": ids[c], "bm25": scores[r, c]})
            both = new if held is None else pd.concat([held, new])
            held = both.sort_values(["seq", "bm25", "id"], ascending=[True, False, True]).groupby("seq", sort=False).head(k)
    if held is not None:
        yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)


def fuse_rrf(a: DataFrame, b: DataFrame, k: int, weight_a: float = 1.0, weight_b: float = 1.0, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``(seq, id, pos)``."""
    x = a.select("seq", "id", F.col("pos").alias("_pa"))
    y = b.select("seq", "id", F.col("pos").alias("_pb"))
    part = lambda c, w: F.coalesce(F.lit(w) / (rrf_k + F.col(c)), F.lit(0.0))
    fused = x.join(y, ["seq", "id"], "full").select("seq", "id", F.round(part("_pa", weight_a) + part("_pb", weight_b), DIGITS).alias("score"))
    w = Window.partitionBy("seq").orderBy(F.desc("score"), "id")
    return fused.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def fuse_weighted(vector: DataFrame, text: DataFrame, k: int, alpha: float = HYBRID_ALPHA) -> DataFrame:
    """``alpha * cosine + (1 - alpha) * bm25 / best bm25 of the query``."""
    top = text.groupBy("seq").agg(F.max("bm25").alias("_top"))
    y = text.join(top, "seq").select("seq", "id", F.coalesce(F.col("bm25") / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0)).alias("_b"))
    x = vector.select("seq", "id", F.col("score").alias("_v"))
    zero = F.lit(0.0)
    fused = x.join(y, ["seq", "id"], "full").select(
        "seq", "id", F.round(alpha * F.coalesce("_v", zero) + (1 - alpha) * F.coalesce("_b", zero), DIGITS).alias("score")
    )
    w = Window.partitionBy("seq").orderBy(F.desc("score"), "id")
    return fused.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def mmr(pool: DataFrame, k: int, lam: float = MMR_LAMBDA) -> DataFrame:
    """Greedy diversification of each query's pool ``(seq, id, score, pos, vec)``.

    The whole pool enters; a candidate without a vector is like no other. The pool is what the caller ranked for one query, and one task holds it with
    one row of similarities, never all pairs.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        width = max((len(v) for v in pdf["vec"] if v is not None), default=1)
        unit, base = _unit(pdf["vec"].map(lambda v: [0.0] * width if v is None else v)), pdf["score"].to_numpy()
        chosen: list[int] = []
        nearest = np.zeros(len(pdf))
        open_ = np.ones(len(pdf), dtype=bool)
        for _ in range(min(k, len(pdf))):
            value = np.where(open_, np.round(lam * base - (1 - lam) * nearest, DIGITS), -np.inf)
            best = int(np.argmax(value))
            chosen.append(best)
            open_[best] = False
            sims = np.round(unit @ unit[best], DIGITS)
            nearest = np.maximum(nearest, sims) if len(chosen) > 1 else sims
        out = pdf.loc[chosen, ["seq", "id", "score"]].copy()
        out["pos"] = range(1, len(out) + 1)
        return out

    id_type = pool.schema["id"].dataType.simpleString()
    ranked = pool.select("seq", "id", "score", "pos", "vec")
    return ranked.groupBy("seq").applyInPandas(pick, f"seq bigint, id {id_type}, score double, pos int")


def comparable_turns(turns: DataFrame, min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return turns.filter((words >= min_words) & (F.length("text") <= max_chars))


def nearest_earlier(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(seq, best)``: the highest cosine of each turn ``(seq, vec)`` with any earlier turn.

    Turns are cut into blocks of consecutive positions; a task scores one pair of blocks, later
    against earlier, and returns one row per later turn. Similarities are never written out.
    """
    from plumbline.operators.ordering import with_dense_index

    placed = with_dense_index(turns.select("seq", "vec"), "seq").withColumn("_b", F.floor(F.col("idx") / block_rows))
    n_blocks = max(1, -(-placed.count() // block_rows))
    later = placed.select("idx", "seq", "vec", F.col("_b").alias("lb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("eb"))
    earlier = placed.select(
        F.col("idx").alias("e_idx"), F.col("vec").alias("e_vec"), F.col("_b").alias("e_eb"),
        F.explode(F.sequence(F.col("_b"), F.lit(n_blocks - 1).cast("long"))).alias("e_lb"),
    )

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"seq": [], "best": []})
        sims = np.round(_unit(a["vec"]) @ _unit(b["e_vec"]).T, DIGITS)
        sims[b["e_idx"].to_numpy()[None, :] >= a["idx"].to_numpy()[:, None]] = np.nan
        with np.errstate(all="ignore"):
            top = np.where(np.isnan(sims).all(axis=1), np.nan, np.fmax.reduce(sims, axis=1))
        return pd.DataFrame({"seq": a["seq"], "best": top})

    scored = later.groupBy("lb", "eb").cogroup(earlier.groupBy("e_lb", "e_eb")).applyInPandas(cell, "seq bigint, best double")
    return scored.groupBy("seq").agg(F.max(F.nullif(F.col("best"), F.lit(float("nan")))).alias("best"))


def repetition_rate(turns: DataFrame, levels: Sequence[float] = LEVELS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Share of turns ``(seq, text, vec)`` with an earlier similar turn at each level; one row.

    Turns without a vector cannot be compared and count as discarded.
    """
    kept = comparable_turns(turns).filter("vec IS NOT NULL")
    best = nearest_earlier(kept, block_rows)
    rates = [
        F.avg(F.coalesce(F.col("best") >= lv, F.lit(False)).cast("double")).alias(f"rate_{round(lv * 100):03d}") for lv in levels
    ]
    sizes = turns.agg(F.count(F.lit(1)).alias("n_turns"))
    return best.agg(F.count(F.lit(1)).alias("n"), *rates).crossJoin(sizes).withColumn(
        "discarded_share", (F.col("n_turns") - F.col("n")) / F.col("n_turns")
    )


def specificity(queries: DataFrame, corpus: DataFrame, top: int = 3) -> DataFrame:
    """Mean of the ``top`` largest IDF values among a query's tokens; unseen tokens count as zero.

    Columns: ``seq, n_tokens, oov_share, specificity, max_idf, specificity_oov_max`` (the last with
    unseen tokens at the largest IDF).
    """

    def words(df: DataFrame, key: str) -> DataFrame:
        found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
        return df.select(key, F.explode(F.array_distinct(found)).alias("term"))

    asked = words(queries, "seq")
    df = words(corpus, "id").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.agg(F.count(F.lit(1)).alias("n_docs"))
    seen = asked.join(df, "term", "left").crossJoin(n)
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1))
    best = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, top)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return (
        seen.withColumn("_idf", F.when(F.col("df").isNotNull(), idf).otherwise(F.lit(0.0)))
        .withColumn("_idf_max", idf)
        .groupBy("seq")
        .agg(
            F.count(F.lit(1)).alias("n_tokens"), F.avg(F.col("df").isNull().cast("double")).alias("oov_share"),
            best(F.col("_idf")).alias("_t"), F.max("_idf").alias("max_idf"), best(F.col("_idf_max")).alias("_tm"),
        )
        .select("seq", "n_tokens", "oov_share", mean(F.col("_t")).alias("specificity"), "max_idf", mean(F.col("_tm")).alias("specificity_oov_max"))
    )
