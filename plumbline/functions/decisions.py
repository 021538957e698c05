"""Structured decisions parsed out of free-text responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import _col, strip

# Lengths kept of each field and the number of concepts.
ASSERTION_CHARS, FIELD_CHARS, MAX_CONCEPTS = 80, 50, 5


def parse_decision(x: Column | str) -> Column:
    """Struct(key_assertion, concepts, domain) of a JSON answer, fenced or not; null if any part is unusable."""
    bare = F.regexp_replace(F.regexp_replace(strip(_col(x)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    v = F.try_parse_json(strip(bare))

    def text(value: Column, chars: int) -> Column:
        s = F.when(F.schema_of_variant(value) == "STRING", strip(F.try_variant_get(value, "$", "string")))
        return F.when(s != "", F.substring(s, 1, chars))

    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    raw = F.when(F.schema_of_variant(field("concepts")).startswith("ARRAY"), F.try_variant_get(v, "$.concepts", "array<variant>"))
    concepts = F.slice(F.array_compact(F.transform(raw, lambda c: text(c, FIELD_CHARS))), 1, MAX_CONCEPTS)
    assertion, domain = text(field("key_assertion"), ASSERTION_CHARS), text(field("domain"), FIELD_CHARS)
    return F.when(
        assertion.isNotNull() & domain.isNotNull() & (F.size(concepts) > 0),
        F.struct(assertion.alias("key_assertion"), concepts.alias("concepts"), domain.alias("domain")),
    )
