"""Document fingerprints as Merkle trees over sections, paragraphs and word runs.

A text is sections (parted by blank lines) of paragraphs (lines) of leaves: runs of four words with the white space around
them. Every leaf has a hash; the hash of a paragraph covers its leaves', that of a section its paragraphs', the root the
sections'. Equal roots mean equal texts, and where roots differ, the branches that differ say where.

The fingerprint is text: the root, then ``|`` before each section, ``;`` between paragraphs, and five hex digits per leaf. The
hashes that go up the tree are whole; only what is written for a leaf is short.

Defined cases: a null text counts as empty; an empty text has a root and no leaf, and is like another text only if that is
empty too; repeated rows are documents of their own, each the next one of its twin; a single document is its own next one;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import numbered, written

LEAF_WORDS = 4
LEAF_DIGITS = 5
_SECTIONS = r"\n[ \t\r]*\n"
_LEAF = rf"(?:\s*+\S++){{1,{LEAF_WORDS}}}+\s*+|\s++"


def _leaves(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(paragraph, F.lit(_LEAF), F.lit(0)), lambda leaf: F.lpad(F.hex(F.xxhash64(leaf)), 16, "0"))


def _tree(text: Column) -> Column:
    """array of sections, each an array of paragraphs, each the array of its leaves' hashes."""
    return F.transform(F.split(text, _SECTIONS, -1), lambda section: F.transform(F.split(section, "\n", -1), _leaves))


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the fingerprint of the text column as ``into``; the tree is made once, in a projection of its own."""
    whole = F.coalesce(F.col(text), F.lit(""))
    paragraph = lambda p: F.md5(F.array_join(p, ""))
    section = lambda s: F.md5(F.array_join(F.transform(s, paragraph), ""))
    # blank lines are of many forms, so the root covers what stands between sections as well
    gaps = F.array_join(F.regexp_extract_all(whole, F.lit(_SECTIONS), F.lit(0)), "")
    top = F.sha2(F.concat_ws(",", F.array_join(F.transform("_tree", section), ""), gaps), 256)
    short = F.transform("_tree", lambda s: F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, lambda h: F.right(h, F.lit(LEAF_DIGITS))), "")), ";"))
    made = df.withColumn("_tree", _tree(whole)).withColumn(into, F.concat(top, F.lit("|"), F.array_join(short, "|")))
    return made.drop("_tree")


def _marks(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substr(print_, F.lit(65)), F.lit(f"[0-9A-F]{{{LEAF_DIGITS}}}"), F.lit(0)))


def root(print_: Column) -> Column:
    return F.substr(print_, F.lit(1), F.lit(64))


def likeness(left: Column, right: Column) -> Column:
    """1 if the roots are equal, else twice the leaves in common over all leaves of both, in 0..1."""
    a, b = _marks(left), _marks(right)
    both = F.size(F.array_intersect(a, b))
    return F.when(root(left) == root(right), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(a) + F.size(b)), F.lit(0.0)))


def differing(left: Column, right: Column) -> Column:
    """Where two fingerprints differ: struct(section, paragraph), from 0, of every place whose paragraphs are not the same.

    Branches are compared by their place in the tree, so a place that only one side has differs as well: what follows a
    deleted, moved or added paragraph in its section has other places and is listed. Sections with equal branches are passed
    over whole. Empty for equal roots; where the roots differ and no place does (in the white space between sections, which
    only the root covers, or by leaves whose short digits are alike), one place of nulls stands for it.
    """
    place = "struct<section:int,paragraph:int>"
    sections = lambda p: F.split(F.substr(p, F.lit(66)), r"\|", -1)
    # a section that one side has not is null there and has no paragraphs
    paragraphs = lambda s: F.coalesce(F.split(s, ";", -1), F.array().cast("array<string>"))
    both = lambda a, b: F.arrays_zip(a.alias("a"), b.alias("b"))

    def of_section(s, i):
        pairs = F.transform(both(paragraphs(s["a"]), paragraphs(s["b"])), lambda p, j: F.when(~p["a"].eqNullSafe(p["b"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(s["a"].eqNullSafe(s["b"]), F.array().cast(f"array<{place}>")).otherwise(F.filter(pairs, lambda p: p.isNotNull()))

    places = F.flatten(F.transform(both(sections(left), sections(right)), of_section))
    hidden = F.array(F.struct(F.lit(None).cast("int").alias("section"), F.lit(None).cast("int").alias("paragraph")))
    # in a lambda the places are worked out once
    shown = F.get(F.transform(F.array(places), lambda p: F.when(F.size(p) > 0, p).otherwise(hidden)), 0)
    return F.when(root(left) == root(right), F.array().cast(f"array<{place}>")).otherwise(shown)


def fingerprinted_with_edits(docs: DataFrame) -> DataFrame:
    """Each document beside an edited version whose last third is replaced by the start of the next document (descending doc_id).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next, and ``edits``,
    the places of paragraphs that differ. Texts are shuffled once; what a document gives to its neighbour is the part that is needed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # _id and _h are never null, so that joins and groups on them share one partitioning
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(text, doc_id.isNull()).alias("_h"), doc_id.alias("doc_id"), text.alias("text"))
    # one row per different (doc_id, text), with the number of such rows
    keys = source.groupBy("_id", "_h").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("twins"), F.max(F.length("text")).alias("n_chars"))
    keys = written(numbered(keys, [F.col("doc_id").asc_nulls_first(), F.col("_h")], "merkle-order"), "merkle-keys")
    total = keys.count()
    taker = keys.select(F.col("_id").alias("to_id"), F.col("_h").alias("to_h"), F.col("n_chars").alias("to_chars"), F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"))
    chain = written(keys.join(taker, "rank").select("_id", "_h", "doc_id", "twins", "to_id", "to_h", "to_chars"), "merkle-chain")
    # texts go by the same columns for both sides, so that one exchange serves givers and takers
    once = source.select("_id", "_h", "text").dropDuplicates(["_id", "_h"])
    rows = with_fingerprint(once.join(chain, ["_id", "_h"]), "text", "fingerprint")
    given = rows.select(
        F.col("to_id").alias("_id"), F.col("to_h").alias("_h"), F.substr("text", F.lit(1), F.floor(F.col("to_chars") / 3).cast("int")).alias("start"),
        F.col("fingerprint").alias("next_fingerprint"),
    )
    met = rows.join(given, ["_id", "_h"])
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    body = met.select("doc_id", "text", n.cast("long").alias("n_chars"), "twins", "start", "next_fingerprint", "fingerprint")
    # a twin's next document is the twin itself, but for the last of them
    each = F.when(F.col("twins") == 1, F.array(F.struct(F.col("start").alias("start"), F.col("next_fingerprint").alias("next")))).otherwise(
        F.concat(
            F.array(F.struct(F.col("start").alias("start"), F.col("next_fingerprint").alias("next"))),
            F.array_repeat(F.struct(F.substr("text", F.lit(1), part).alias("start"), F.col("fingerprint").alias("next")), (F.col("twins") - 1).cast("int")),
        )
    )
    body = body.select("doc_id", "text", "n_chars", "fingerprint", F.explode(each).alias("own"))
    edited = F.concat(F.substr("text", F.lit(1), n - part), F.col("own.start"))
    body = body.select("doc_id", "n_chars", "fingerprint", F.col("own.next").alias("next_fingerprint"), edited.alias("edited"))
    body = with_fingerprint(body, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    left, right, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return body.withColumn("near_edited", likeness(left, right)).withColumn("near_next", likeness(left, following)).withColumn("edits", differing(left, right))
