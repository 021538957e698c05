"""Secrets: fixed patterns, and strings that a character Markov model of random text explains better than one of identifiers.

Labelled samples train both models: what the patterns find is random text; every other run of token characters that is too
short to be a secret is ordinary, so that secrets which no pattern knows do not teach the wrong model. Transition counts are
taken over all documents and added up; rare ones lean on the frequencies of single characters. A token of at least ``LEAST``
characters outside the pattern matches is a secret of kind ``random`` if the log-likelihood ratio of the models reaches
``RATIO`` in all and ``RATIO_PER_CHAR`` per character, and it has a letter: a bare number is no credential.

Defined cases: a null or empty text has no span; repeated rows get equal spans; without one labelled random string there is
no model and only the patterns count; extra columns stay, one called like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import SLICE, annotated, utf8

KINDS = ("assign", "access", "hex", "random")
LEAST = 16
RATIO = 14.0
RATIO_PER_CHAR = 0.6
BACKOFF = 20  # counts that the frequencies of single characters are worth in each row of a model

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LETTERS = 52  # the first symbols
STATES = len(_SYMBOLS) + 1  # 0 is the edge of a token
CODE = np.zeros(256, np.uint8)
CODE[list(_SYMBOLS)] = np.arange(1, STATES)
_TO_SPACE = bytes(b if b in _SYMBOLS else 32 for b in range(256))

RESULT = T.StructType([T.StructField(k, T.ArrayType(T.IntegerType())) for k in KINDS])  # start, end, start, end, ... in code points


def pattern_spans(text: str, data: bytes) -> dict[str, list[tuple[int, int]]]:
    """Spans of the three patterns; a pattern is only tried where the bytes can hold it."""
    found: dict[str, list[tuple[int, int]]] = {}
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in data:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if any(len(w) >= LEAST_HEX for w in data.translate(_TO_SPACE).split()):
        found["hex"] = [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return found


def values_of(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[str]:
    """The random part of each match: a value, a key id or digits."""
    whole = [text[s:e] for kind in ("access", "hex") for s, e in spans.get(kind, ())]
    return whole + [ASSIGN.match(text, s)[2] for s, _ in spans.get("assign", ())]


def _transitions(data: bytes) -> np.ndarray:
    code = CODE[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.int64)
    pairs = code[:-1] * STATES + code[1:]
    return np.bincount(pairs, minlength=STATES * STATES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordinary, random = np.zeros(STATES * STATES, np.int64), np.zeros(STATES * STATES, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            plain, values = [], []
            for data in utf8(batch.column(0).slice(at, SLICE)):
                if not data:
                    continue
                text = None
                if any(len(w) >= LEAST_HEX for w in data.translate(_TO_SPACE).split()) or b"AKIA" in data or any(k in data.lower() for k in KEYWORDS):
                    text = data.decode()
                    spans = pattern_spans(text, data)
                    values += values_of(text, spans)
                    for s, e in sorted((x for own in spans.values() for x in own), reverse=True):
                        text = text[:s] + " " * (e - s) + text[e:]
                tokens = (text.encode() if text is not None else data).translate(_TO_SPACE).split()
                plain.append(b" ".join([w for w in tokens if len(w) < LEAST]))
            ordinary += _transitions(b" ".join(plain))
            random += _transitions(" ".join(values).encode())
    cells = np.flatnonzero(ordinary + random)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(ordinary[cells]), pa.array(random[cells])], names=["cell", "ordinary", "random"])


def fit(docs: DataFrame) -> np.ndarray | None:
    """Log-likelihood ratio of each transition, random over ordinary; None without a labelled random string."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "cell int, ordinary long, random long")
    rows = counts.groupBy("cell").agg(F.sum("ordinary").alias("ordinary"), F.sum("random").alias("random")).collect()  # at most STATES squared
    both = np.zeros((2, STATES, STATES))
    for r in rows:
        both[0].flat[r.cell], both[1].flat[r.cell] = r.ordinary, r.random
    both[:, 0, 0] = 0  # between tokens
    if not both[1].sum():
        return None
    single = both.sum(1, keepdims=True) + 1
    single /= single.sum(2, keepdims=True)
    logs = np.log((both + BACKOFF * single) / (both.sum(2, keepdims=True) + BACKOFF))
    return logs[1] - logs[0]


class _Judge(dict):
    def __init__(self, ratios: np.ndarray):
        super().__init__()
        self.ratios = ratios

    def __missing__(self, token: bytes) -> bool:
        if len(self) > 200_000:
            self.clear()
        code = CODE[np.frombuffer(b" " + token + b" ", np.uint8)]
        total = float(self.ratios[code[:-1], code[1:]].sum())
        value = self[token] = total >= RATIO and total >= RATIO_PER_CHAR * len(token) and bool((code[1:-1] <= LETTERS).any())
        return value


def _finder(ratios: np.ndarray | None):
    judge = None if ratios is None else _Judge(ratios)

    def find(texts):
        out = []
        for data in texts:
            if not data:
                out.append(tuple([] for _ in KINDS))
                continue
            long = [w for w in data.translate(_TO_SPACE).split() if len(w) >= LEAST]
            odd = judge is not None and any(judge[w] for w in long)
            if not odd and b"AKIA" not in data and not any(len(w) >= LEAST_HEX for w in long) and not any(k in data.lower() for k in KEYWORDS):
                out.append(tuple([] for _ in KINDS))
                continue
            text = data.decode()
            spans = pattern_spans(text, data)
            if odd:
                taken = sorted(x for own in spans.values() for x in own)
                spans["random"] = [
                    (m.start(), m.end()) for m in TOKEN.finditer(text)
                    if m.end() - m.start() >= LEAST and judge[m[0].encode()] and not any(s < m.end() and m.start() < e for s, e in taken)
                ]
            out.append(tuple([i for span in spans.get(k, ()) for i in span] for k in KINDS))
        return out

    return find


def secrets(docs: DataFrame, ratios: np.ndarray | None, into: str = "secrets") -> DataFrame:
    """``docs`` with the struct ``into``: of each kind, the starts and ends of its spans in code points."""
    return annotated(docs, "text", into, RESULT, _finder, ratios)


def listed(into: str, kinds: tuple[str, ...]):
    """kind:start:end of the spans of some kinds, by start and then by kind as listed, comma-joined."""

    def spans(k: int, kind: str):
        flat = F.col(f"{into}.{kind}")
        at = F.when(F.size(flat) > 0, F.sequence(F.lit(0), F.size(flat) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.get(flat, i).alias("s"), F.lit(k).alias("k"), F.get(flat, i + 1).alias("e")))

    names = F.array(*[F.lit(k) for k in KINDS])
    rows = F.array_sort(F.flatten(F.array(*[spans(k, kind) for k, kind in enumerate(KINDS) if kind in kinds])))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")
