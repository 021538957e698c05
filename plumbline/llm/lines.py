"""Line dedup with a suffix array over line ids: later copies of repeated line runs are deleted.

Documents in order of doc_id are one sequence of lines with a barrier after each document. A line that occurs once cannot be
part of a repeat, so the array is built over the others.

Prefix doubling: ``rank 0`` of a place is the dense rank of its line; ``rank k + 1`` is the dense rank of the pair (rank k of the
place, rank k of the place 2^k lines on), kept only where the pair occurs twice. Places with equal rank k share 2^k lines, and
ranks are in the order of the suffixes. Doubling stops when no pair repeats, so rounds follow the longest repeat's logarithm.

Longest common prefixes: from the largest k down, the places of an interval (places that share p lines, kept under its first
place) that also agree in rank k at p lines on form an interval of p + 2^k lines. All but its first place go on there; the first
stays, as it may share less with still earlier places of the wider interval, and is counted in the new one as well. In the
end every place has the length of its longest match with an earlier place: the interval and its length are a maximal repeated run.

A run of at least ``min_words`` words is deleted from every place but its first. What is deleted is the union of these runs.

Defined cases: a null text has no line and stays null; an empty text has one empty line; in a run that overlaps its own copy
the first lines stay; repeated rows are documents of their own, so all but the first lose their long runs; ties in doc_id are
broken by a hash of the text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.shared import numbered, remove, shared_folder, written

MIN_WORDS = 50
AT = ("doc", "line")


def _place(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc").alias("doc"), F.col(f"{prefix}line").alias("line"))


def line_table(texts: DataFrame) -> DataFrame:
    """row, line, hash, words of every line of ``texts`` (row, text)."""
    lines = texts.where("text IS NOT NULL").select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    words = F.regexp_count("content", F.lit(r"\S+"))
    return lines.select("row", F.col("line").cast("long").alias("line"), F.unhex(F.md5("content")).alias("content"), words.cast("long").alias("words"))


def _dense(pairs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The keys that occur at least twice, with their dense rank in order."""
    twice = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return numbered(twice, [F.col(k) for k in keys], label, "named")


def doubled_ranks(lines: DataFrame, order: DataFrame, folder: str) -> list[DataFrame]:
    """Tables (doc, line, rank, words), one per k: the places whose 2^k lines occur again, their rank and those lines' words.

    ``lines`` have the row of their document; ``order`` (row, doc) tells its place, and only lines that occur again meet it.
    """
    first = _dense(lines, ["content"], "line-ids")
    again = lines.join(first.hint("merge"), "content").select("row", "line", F.col("named").alias("rank"), "words")
    levels = [written(again.join(order.hint("merge"), "row").select("doc", "line", "rank", "words"), "", f"{folder}/rank0")]
    while True:
        k = len(levels) - 1
        here = levels[-1]
        there = here.select("doc", (F.col("line") - (1 << k)).alias("line"), F.col("rank").alias("after"), F.col("words").alias("more"))
        pairs = written(here.join(there.hint("merge"), list(AT)).select("doc", "line", "rank", "after", (F.col("words") + F.col("more")).alias("words")), "", f"{folder}/pairs{k}")
        named = _dense(pairs, ["rank", "after"], "pair-ids")
        level = written(pairs.join(named.hint("merge"), ["rank", "after"]).select("doc", "line", F.col("named").alias("rank"), "words"), "", f"{folder}/rank{k + 1}")
        remove(lines.sparkSession, f"{folder}/pairs{k}")
        if level.isEmpty():
            return levels
        levels.append(level)


def repeated_runs(levels: list[DataFrame], folder: str) -> DataFrame:
    """doc, line, length, words, first: of each place, its longest match with an earlier one, and the first place of that interval."""
    # ``first`` and ``length`` name an interval; a place that only stands for it is not ``later``. A place of length 0 is not kept:
    # it is among those of the next level as well.
    state = None
    for k in range(len(levels) - 1, -1, -1):
        fresh, seen = levels[k], None
        if state is not None:
            fresh = fresh.join(state.where("later").select(*AT).hint("merge"), list(AT), "left_anti")
            ranks = levels[k].select(F.col("doc").alias("r_doc"), F.col("line").alias("r_line"), "rank", F.col("words").alias("more"))
            seen = state.withColumn("at", F.col("line") + F.col("length"))
            seen = seen.join(ranks.hint("merge"), (F.col("doc") == F.col("r_doc")) & (F.col("at") == F.col("r_line")), "left").drop("r_doc", "r_line", "at")
        none = [F.lit(None).cast("struct<doc:long,line:long>").alias("first"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("later")]
        fresh = fresh.select("doc", "line", *none, "rank", F.col("words").alias("more"))
        seen = written(fresh if seen is None else seen.unionAll(fresh), "", f"{folder}/seen{k}")
        ranked = seen.where("rank IS NOT NULL")
        inner = ranked.groupBy("first", "length", "rank").agg(F.min(_place()).alias("new"), F.count("*").alias("n")).where("n > 1")
        inner = written(inner.select(F.col("first").alias("i_first"), F.col("length").alias("i_length"), F.col("rank").alias("i_rank"), "new"), "", f"{folder}/inner{k}")
        met = F.col("first").eqNullSafe(F.col("i_first")) & (F.col("length") == F.col("i_length")) & (F.col("rank") == F.col("i_rank"))
        both = ranked.join(inner.hint("merge"), met, "left")
        is_first = _place() == F.col("new")
        kept = ["doc", "line", "first", "length", "words", "later"]
        # one row goes on, or stays, or does both: the first of an interval
        grown = F.struct(F.col("new").alias("first"), (F.col("length") + (1 << k)).alias("length"), (F.col("words") + F.col("more")).alias("words"), (F.col("later") & ~is_first).alias("later"))
        stays = F.struct("first", "length", "words", "later")
        goes = F.when(F.col("new").isNull(), F.array(stays)).when(is_first, F.array(stays, grown)).otherwise(F.array(grown))
        moved = both.select("doc", "line", F.explode(goes).alias("to")).select("doc", "line", "to.*").where("length > 0")
        state = written(moved.select(*kept).unionAll(seen.where("rank IS NULL").select(*kept)), "", f"{folder}/state{k}")
        for old in (f"seen{k}", f"inner{k}", f"state{k + 1}"):
            remove(state.sparkSession, f"{folder}/{old}")
    return state.where("later AND length > 0").select("doc", "line", "length", "words", "first")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, text: every document without the lines of later copies of long runs."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lines")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    source = written(source, "", f"{folder}/texts")
    order = numbered(source.select("row", "doc_id", F.xxhash64("text").alias("h")), [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")], "line-docs", "doc")
    order = written(order.select("row", "doc"), "", f"{folder}/order")
    lines = written(line_table(source), "", f"{folder}/lines")
    levels = doubled_ranks(lines, order, folder)
    remove(spark, f"{folder}/lines")
    runs = repeated_runs(levels, folder).where(F.col("words") >= min_words)
    # runs of one document that meet are one stretch
    before = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    ends = runs.select("doc", "line", (F.col("line") + F.col("length")).alias("end"))
    opened = ends.withColumn("opens", F.coalesce(F.col("line") > F.max("end").over(before), F.lit(True)).cast("int"))
    number = opened.withColumn("stretch", F.sum("opens").over(Window.partitionBy("doc").orderBy("line", "end").rowsBetween(Window.unboundedPreceding, 0)))
    stretches = number.groupBy("doc", "stretch").agg(F.min("line").alias("s"), F.max("end").alias("e"))
    cut = stretches.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("cuts"), F.sum(F.col("e") - F.col("s")).alias("n_deleted"))
    cut = written(cut.join(order.hint("merge"), "doc").select(F.col("row").alias("_row"), "cuts", "n_deleted"), "", f"{folder}/cuts")
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.exists("cuts", lambda c: (i >= c.s) & (i < c.e)))
    # cuts grow with the corpus, as all that is joined here does, so it is by sort-merge joins at every size
    out = source.join(cut.hint("merge"), source["row"] == cut["_row"], "left")
    return out.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_deleted"), F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
