"""Claim support: mechanical negation and per-pair verifier scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import _col, claim_tokens, overlap_share, strings

# The verbs after which a negation is inserted, the prefix otherwise, the divisor.
NEGATABLE_VERBS = (
    "requer", "requerem", "passaram", "passou", "existe", "existem",
    "deve", "devem", "pode", "podem", "tem", "têm", "usa", "usam",
    "precisa", "precisam", "gera", "geram", "causa", "causam",
    "permite", "permitem", "é", "e", "sao", "são", "foi", "foram",
    "esta", "está", "estao", "estão",
)
NEGATION_WORD = "nao"
NEGATION_PREFIX = "Nao e verdade que "
BLIND_DIVISOR = 100.0
NEGATION_MARKER = r"(?i)\b(nao|não|not|nicht|no|ne|pas)\b"

Verifier = Callable[[Column, Column], Column]


def negate(claim: Column | str, verbs=NEGATABLE_VERBS, word: str = NEGATION_WORD, prefix: str = NEGATION_PREFIX) -> Column:
    """Struct(text, rule): ``word`` after the first known verb, else ``prefix`` in front."""
    text = F.coalesce(_col(claim), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"[^0-9A-Za-zÀ-ÿ]", "")))
    first_verb = F.try_element_at(F.filter(bare, lambda w: F.array_contains(strings(verbs), w)), F.lit(1))
    place = F.array_position(bare, first_verb).cast("int")
    joined = F.array_join(F.array_insert(words, place + 1, F.lit(word)), " ")
    return F.when(
        first_verb.isNotNull(), F.struct(joined.alias("text"), F.concat(F.lit("verbo:"), first_verb).alias("rule"))
    ).otherwise(F.struct(F.concat(F.lit(prefix), text).alias("text"), F.lit("prefixo").alias("rule")))


def blind_score(claim: Column, text: Column) -> Column:
    """Depends on the size of the claim only; the negative control."""
    return F.size(claim_tokens(claim)) / F.lit(BLIND_DIVISOR)


def lexical_score(claim: Column, text: Column) -> Column:
    return overlap_share(claim_tokens(claim), claim_tokens(text))


def negation_asymmetry(a: Column, b: Column, marker: str = NEGATION_MARKER) -> Column:
    """Exactly one of the two texts carries a negation marker."""
    return F.coalesce(a, F.lit("")).rlike(marker) != F.coalesce(b, F.lit("")).rlike(marker)


def lexical_negation_score(claim: Column, text: Column) -> Column:
    return F.when(negation_asymmetry(claim, text), F.lit(0.0)).otherwise(lexical_score(claim, text))


VERIFIERS: dict[str, Verifier] = {
    "cego": blind_score,
    "lexico": lexical_score,
    "lexico_negacao": lexical_negation_score,
}
