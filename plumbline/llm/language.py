"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of letters binds the vectors of its letters, each permuted by its
place, by multiplication; a text bundles its n-grams by addition. Texts of one language bundle to its prototype, and a
document gets the language whose prototype has the largest cosine with its own vector.

Prototypes come from counts of n-grams over all documents to learn from; whatever is not a letter is one gap symbol.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learned; ties
go to the first language by name; a null language teaches nothing; repeated rows are rated alike; extra columns stay, one
called like the result is replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import SLICE, annotated, utf8

SYMBOLS = 64  # the gap, 26 letters, and slots for all other letters by their code point
GRAM = 3
DIMENSIONS = 512
SEED = 5
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def alphabet() -> np.ndarray:
    """The symbol of every code point, 0 where it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    letters = np.fromiter((i for i in range(sys.maxunicode + 1) if chr(i).isalpha()), np.int64)
    out[letters] = 27 + letters * 40503 % (SYMBOLS - 27)
    out[97:123] = np.arange(1, 27)
    return out


def vectors() -> list[np.ndarray]:
    """The letters' vectors, permuted for each place of an n-gram."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    base[0] = np.random.default_rng(SEED + 1).choice(np.array([-1, 1], np.int8), DIMENSIONS)
    return [np.roll(base, GRAM - 1 - k, 1) for k in range(GRAM)]


def grams(text: bytes | None, symbols: np.ndarray) -> np.ndarray | None:
    """The codes of all n-grams of a text between two gaps; None without a letter. Runs of other characters are one gap."""
    if not text:
        return None
    code = symbols[np.frombuffer(text.decode().lower().encode("utf-32-le", "replace"), np.uint32)]
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]]).astype(np.int64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code = code[keep]
    out = code[: len(code) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out = out * SYMBOLS + code[k : len(code) - GRAM + 1 + k]
    return out


def bundle(codes: np.ndarray, counts: np.ndarray, letters: list[np.ndarray], kind=np.float32) -> np.ndarray:
    """The sum of n-gram vectors, each times its count."""
    total = np.zeros(DIMENSIONS, kind)
    for at in range(0, len(codes), 4096):
        part = codes[at : at + 4096]
        bound = letters[GRAM - 1][part % SYMBOLS]
        for k in range(GRAM - 2, -1, -1):
            part = part // SYMBOLS
            bound = bound * letters[k][part % SYMBOLS]
        total += counts[at : at + 4096].astype(kind) @ bound.astype(kind)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols, counts = alphabet(), {}
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                found = grams(text, symbols)
                if found is not None:
                    if lang not in counts:
                        counts[lang] = np.zeros(SYMBOLS**GRAM, np.int64)
                    codes, n = np.unique(found, return_counts=True)
                    counts[lang][codes] += n
    for lang, own in counts.items():
        cells = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(own[cells])], names=["lang", "gram", "n"])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the n-gram vectors of each language in a partition. Whole numbers, so their order does not show."""
    letters, sums = vectors(), {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes, n, place = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            sums[lang] = sums.get(lang, 0) + bundle(codes[place == i], n[place == i], letters, np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "sums"])


@dataclass
class Prototypes:
    langs: list[str]
    unit: np.ndarray  # languages x dimensions, each of length 1

    def rater(self):
        symbols, letters = alphabet(), vectors()

        def rate(texts):
            out = []
            for text in texts:
                found = grams(text, symbols)
                if found is None or not self.langs:
                    out.append((UNKNOWN, 0.0))
                    continue
                codes, n = np.unique(found, return_counts=True)
                own = bundle(codes, n, letters)
                likeness = self.unit @ own / max(float(np.linalg.norm(own)), 1e-9)
                best = int(np.argmax(likeness))
                out.append((self.langs[best], float(min(max(likeness[best], 0.0), 1.0))))
            return out

        return rate


def fit(docs: DataFrame, learn=None) -> Prototypes:
    """Prototypes of the languages of ``docs`` (text, lang) where ``learn`` holds."""
    docs = docs.where("lang IS NOT NULL") if learn is None else docs.where(F.col("lang").isNotNull() & learn)
    counts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "lang string, gram int, n long")
    # at most SYMBOLS ** GRAM rows per language, whatever the number of tasks; of each partition its sums come to the driver
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums: dict[str, np.ndarray] = {}
    for row in summed.mapInArrow(_bundles, "lang string, sums array<double>").toLocalIterator():
        sums[row.lang] = sums.get(row.lang, 0) + np.array(row.sums)
    langs = sorted(sums)
    unit = np.array([sums[x] / max(float(np.linalg.norm(sums[x])), 1e-9) for x in langs], np.float32).reshape(len(langs), DIMENSIONS)
    return Prototypes(langs, unit)


def identified(docs: DataFrame, prototypes: Prototypes, into: str = "language") -> DataFrame:
    """``docs`` with ``into.lang`` and ``into.score``, the cosine, in 0..1."""
    return annotated(docs, "text", into, RESULT, Prototypes.rater, prototypes)
