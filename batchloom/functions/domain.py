"""Readings of the identifiers and cells of batch tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written forms of "no value" in category columns, compared in lower case without outer blanks.
NO_VALUE_WORDS = ("", "-", "?", "n/a", "na", "none", "null", "nan", "unknown", "not recorded", "missing", "tbd", "pending")

# The media under the spelling in which they are reported.
MEDIA = ("0.1N HCl", "pH 4.5 acetate", "pH 6.8 phosphate")

BATCH_ID = r"\AB[0-9]{8}([-/._][A-Za-z]?[0-9]+)?\z"


def finite(value: Column) -> Column:
    """``value`` with NaN and both infinities read as missing."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def squeezed(text: Column) -> Column:
    """Upper case without any blanks: the key under which spellings of one identifier agree."""
    return F.upper(F.regexp_replace(text, r"[\s ]+", ""))


def usable_word(text: Column) -> Column:
    """A category label, or NULL where it stands for "no value"."""
    bare = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.when(F.lower(bare).isin(*NO_VALUE_WORDS), None).otherwise(bare)


def formulation_number(label: Column) -> Column:
    """The number a formulation label carries, as long; NULL for placeholders.

    Case, blanks, punctuation, zero padding and anything after the number
    (revisions, variants) do not matter.
    """
    digits = F.regexp_extract(label, r"(?i)^[^0-9a-z]*f(?:orm(?:ulation)?)?[^0-9a-z]*([0-9]+)", 1)
    return digits.try_cast("bigint")


def stem(batch: Column) -> Column:
    """The nine characters that a batch shares with its sub-lots."""
    return F.substring(batch, 1, 9)


def canonical_medium(text: Column) -> Column:
    """The medium under its reported spelling; unknown media keep theirs, trimmed."""
    key, out = squeezed(text), F.when(text.isin(*MEDIA), text)
    for name in MEDIA:
        out = out.when(key == name.upper().replace(" ", ""), name)
    return out.otherwise(F.trim(text))


def minute(time_h: Column) -> Column:
    """The time point of an inexactly written time: the nearest whole minute."""
    return F.round(finite(time_h) * 60).cast("int")
