"""Which value does a free-text answer report?"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import CHRONOLOGY_DOUBT, NOISE_TERMS, UNCERTAINTY_TERMS, _col, contains_any, strings

# Accepted answers and the patterns that recognise each value.
ACCEPTED_TIMES = ("14h30", "14:30")
MEETING_TIMES = {
    "14h30": r"14h30|14:30",
    "15h": r"15h(00)?(?!\d)|15:00",
    "16h": r"16h(00)?(?!\d)|16:00",
}
MEETING_TIMES_TWO = {
    "14h30": r"14h30|14:30",
    "15h": r"15h(00)?(?!\d)|15:00",
}
INJECTION_TIMES = {
    "14h30": r"14h30|14:30",
    "18h": r"18h(00)?(?!\d)|18:00",
}
TIME_PATTERN = r"(\d{1,2}h\d{0,2}|\d{1,2}:\d{2})"
SENTENCE_BREAK = r"[.!?\n]+"

ValueDetector = Callable[[Column], Column]


def normalize_times(x: Column | str) -> Column:
    """Lower case, no spaces around ``h`` and ``:`` (``14 h 30`` becomes ``14h30``)."""
    low = F.lower(F.coalesce(_col(x), F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, r"\s*h\s*", "h"), r"\s*:\s*", ":")


def is_accepted(x: Column | str, accepted: Sequence[str] = ACCEPTED_TIMES) -> Column:
    return contains_any(normalize_times(x), accepted)


def detector(patterns: Mapping[str, str], prepare: ValueDetector = normalize_times) -> ValueDetector:
    """A function from a text column to the array of value names whose pattern occurs in it."""

    def found(text: Column) -> Column:
        prepared = prepare(text)
        hits = [F.when(prepared.rlike(p), F.lit(name)) for name, p in patterns.items()]
        return F.array_compact(F.array(*hits))

    return found


def only_value(found: Column) -> Column:
    """The single value present, null for none or several."""
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def concluded_value(x: Column | str, values: ValueDetector) -> Column:
    """The value an answer settles on.

    One value present is the conclusion; among several, the last sentence that names any
    decides, and is undecided (null) if it names more than one.
    """
    text = F.coalesce(_col(x), F.lit(""))
    found = values(text)
    per_sentence = F.filter(F.transform(F.split(text, SENTENCE_BREAK), values), lambda v: F.size(v) > 0)
    last = F.try_element_at(per_sentence, F.lit(-1))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).when(F.size(found) > 1, only_value(last))


def doubts_chronology(x: Column | str, markers: Sequence[str] = CHRONOLOGY_DOUBT) -> Column:
    return contains_any(F.lower(_col(x)), markers)


def response_signals(
    x: Column | str,
    accepted: Sequence[str] = ACCEPTED_TIMES,
    noise: Sequence[str] = NOISE_TERMS,
    uncertainty: Sequence[str] = UNCERTAINTY_TERMS,
    value_pattern: str = TIME_PATTERN,
) -> Column:
    """Length, noise, uncertainty, wrong-value and accepted flags of one response."""
    raw = F.coalesce(_col(x), F.lit(""))
    low = F.lower(raw)
    normed = normalize_times(raw)
    times = F.regexp_extract_all(normed, F.lit(value_pattern), 1)
    wrong = F.exists(times, lambda t: ~F.exists(strings(accepted), lambda a: F.contains(t, a)))
    return F.struct(
        F.length(raw).alias("n_chars"),
        contains_any(low, noise).alias("mentions_noise"),
        contains_any(low, uncertainty).alias("uncertain"),
        wrong.alias("wrong_value"),
        contains_any(normed, accepted).alias("accepted"),
    )
