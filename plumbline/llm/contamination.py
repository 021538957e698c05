"""Benchmark contamination by a prefix-filtered set join with exact containment.

A window is so many consecutive words of a benchmark item (a shorter item is one window). A document holds a window only
if it holds each of its words, so with words ordered by rarity in the corpus one prefix word, the rarest, is necessary:
documents meet windows through that word alone. Its offset bounds where the window would have to start and end (positional
bound), the number of benchmark words in between has to be the window's length (length bound), and what is left is compared
word by word.

Benchmark items are taken in chunks of a bounded number of bytes, one broadcast at a time; documents are never shuffled.

Defined cases: null or wordless texts and items match nothing; repeated items each count; repeated documents get equal
results; an empty benchmark leaves all counts at 0; extra columns stay, one called like the result is replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import WORD_BYTES, annotated, utf8

WINDOW = 13
CHUNK_BYTES = 8 << 20  # of item texts in one broadcast
PAIRS = 1 << 18  # candidate places that are compared at one time

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),  # start, end, start, end, ... in words, merged
    T.StructField("items", T.ArrayType(T.StringType())),  # ids of items with an occurring window, sorted as strings
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The distinct windows of some items, to be met through their rarest words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        owners = defaultdict(set)
        self.vocabulary: dict[bytes, int] = {}
        for item_id, text in items:
            words = words_of(text)
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            n = min(window, len(codes))
            for i in range(len(codes) - n + 1 if n else 0):
                owners[tuple(codes[i : i + n])].add(item_id)
        self.owners = [sorted((o for o in x if o is not None)) for x in owners.values()]
        self.windows = list(owners)

    def order(self, counts: dict[bytes, int]) -> None:
        """Sort out windows by their rarest word."""
        rarity = np.zeros(len(self.vocabulary) + 1, np.int64)
        for w, code in self.vocabulary.items():
            rarity[code] = counts.get(w, 0)
        sizes = np.array([len(w) for w in self.windows], np.int64)
        self.sizes = sizes
        self.words = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 1), np.int64)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w
        offsets = [min(range(len(w)), key=lambda k, w=w: (rarity[w[k]], w[k])) for w in self.windows]
        anchors = np.array([w[o] for w, o in zip(self.windows, offsets)], np.int64)
        by = np.argsort(anchors, kind="stable")
        self.by_anchor = by
        self.offsets = np.array(offsets, np.int64)
        self.first = np.searchsorted(anchors[by], np.arange(len(self.vocabulary) + 2))
        self.windows = []

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans of all windows that occur, and the items they belong to."""
        known = self.vocabulary
        codes = np.array([known.get(w, 0) for w in words], np.int64)
        places = np.flatnonzero(self.first[codes + 1] - self.first[codes] * (codes > 0) > 0) if len(codes) else codes
        places = places[codes[places] > 0]
        if not len(places):
            return [], set()
        inside = np.concatenate([[0], np.cumsum(codes > 0)])
        spans, items = set(), set()
        many = self.first[codes[places] + 1] - self.first[codes[places]]
        ends = np.cumsum(many)
        at = 0
        while at < len(places):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            p, m = places[at:upto], many[at:upto]
            starts_of = self.first[codes[p]]
            w = self.by_anchor[np.repeat(starts_of - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
            start = np.repeat(p, m) - self.offsets[w]
            end = start + self.sizes[w]
            fits = (start >= 0) & (end <= len(codes))
            w, start, end = w[fits], start[fits], end[fits]
            full = inside[end] - inside[start] == end - start
            w, start = w[full], start[full]
            for n in np.unique(self.sizes[w]).tolist():
                own = self.sizes[w] == n
                a, b = w[own], start[own]
                same = (codes[b[:, None] + np.arange(n)] == self.words[a, :n]).all(1)
                spans.update((s, s + n) for s in b[same].tolist())
                for i in np.unique(a[same]).tolist():
                    items.update(self.owners[i])
            at = upto
        return sorted(spans), items


def _count(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, known = Counter(), vocabulary.value
    for batch in batches:
        for text in utf8(batch.column(0)):
            counts.update(known.intersection(words_of(text)))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _prober(column: str, windows):
    index = windows.value

    def probe(texts):
        out = []
        for text in texts:
            words = words_of(text)
            spans, items = index.find(words)
            flat, hit = merged(spans)
            out.append((len(words), hit, flat, sorted(items)))
        return out

    return probe


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Overlapping spans as one flat list of starts and ends, and the number of words below them."""
    flat: list[int] = []
    for s, e in spans:
        if flat and s <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += [s, e]
    return flat, sum(flat[1::2]) - sum(flat[::2])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, into: str = "contamination") -> DataFrame:
    """``docs`` with the struct ``into``: n_words, n_hit (words inside any occurrence of a window), spans and items."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + n_bytes // CHUNK_BYTES
    docs = docs.select(*[c for c in docs.columns if c != into])
    for k in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).collect() if chunks > 1 else items.collect()
        index = Windows([(r.item_id, r.text.encode()) for r in rows], window)
        vocabulary = spark.sparkContext.broadcast(frozenset(index.vocabulary))
        counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_count, vocabulary), "word binary, n long")
        index.order({bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()})
        vocabulary.destroy()
        docs = annotated(docs, "text", f"{into}_{k}" if chunks > 1 else into, RESULT, _prober, into, spark.sparkContext.broadcast(index))
    if chunks == 1:
        return docs
    parts = [f"{into}_{k}" for k in range(chunks)]
    pairs = F.array_sort(F.flatten(F.array(*[_pairs(f"{p}.spans") for p in parts])))
    whole = F.aggregate(pairs, F.array().cast("array<struct<s:int,e:int>>"), _extend)
    spans = F.flatten(F.transform(whole, lambda x: F.array(x.s, x.e)))
    hit = F.aggregate(whole, F.lit(0).cast("long"), lambda n, x: n + (x.e - x.s))
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"{p}.items" for p in parts]))))
    return docs.withColumn(into, F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), hit.alias("n_hit"), spans.alias("spans"), found.alias("items"))).drop(*parts)


def _pairs(flat: str):
    at = F.sequence(F.lit(0), F.size(flat) - 1, F.lit(2))
    made = F.transform(at, lambda i: F.struct(F.get(flat, i).alias("s"), F.get(flat, i + 1).alias("e")))
    return F.when(F.size(flat) > 0, made).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _extend(done, x):
    last = F.element_at(done, -1)
    grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.s.alias("s"), F.greatest(last.e, x.e).alias("e"))))
    return F.when((F.size(done) > 0) & (x.s <= last.e), grown).otherwise(F.concat(done, F.array(x)))
