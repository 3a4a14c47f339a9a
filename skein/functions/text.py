"""Column functions for text: normal forms, numbers in text, trigrams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Latin blocks that are a plain letter with marks, and these plain letters.
ACCENTED, PLAIN = (
    "".join(x)
    for x in zip(*(
        (chr(k), unicodedata.normalize("NFD", chr(k))[0])
        for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
        if len(unicodedata.normalize("NFD", chr(k))) > 1
    ))
)


def normalize_text(c: Column) -> Column:
    """MAP-16: without accents, lower case, trimmed."""
    return F.trim(F.lower(F.translate(F.regexp_replace(c, r"\p{M}", ""), ACCENTED, PLAIN)))


def normalize_identifier(c: Column) -> Column:
    """MAP-17: the normal form with a-z and 0-9 only."""
    return F.regexp_replace(normalize_text(c), "[^a-z0-9]", "")


def parse_localized_number(c: Column) -> Column:
    """MAP-18: numbers such as 1.500, 1,500.5 or $ 12,5 as double; null if it is none."""
    t = F.regexp_replace(c, r"[\s$€]", "")
    dots = t.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$")
    commas = t.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    plain = (
        F.when(dots, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(commas, F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike("^-?[0-9]+,[0-9]+$"), F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t)
    )
    return plain.cast("double")


def attribute_key(c: Column) -> Column:
    """MAP-19: a key of a-z, 0-9 and single underscores."""
    return F.regexp_replace(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def humanize(c: Column) -> Column:
    """MAP-19: words from camelCase or snake_case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")))


def gid_number(c: Column) -> Column:
    """MAP-19: the digits at the end of a global id."""
    return F.nullif(F.regexp_extract(c, "([0-9]+)$", 1), F.lit(""))


def number_text(c: Column) -> Column:
    """MAP-2: a number as text, whole numbers without decimals; null is empty."""
    whole = c == F.floor(c)
    return F.coalesce(F.when(whole, F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), F.lit(""))


def to_string_array(c: Column) -> Column:
    """MAP-5: comma text as trimmed, non-empty members; null is the empty array."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def coerce_boolean(c: Column) -> Column:
    """MAP-4: true for true and 1 only."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1"), F.lit(False))


def words(c: Column) -> Column:
    """Distinct words of the normal form."""
    return F.array_distinct(F.regexp_extract_all(normalize_text(c), F.lit("[a-z0-9]+"), F.lit(0)))


def trigrams(c: Column) -> Column:
    """LEX-5: distinct trigrams of the words, each padded with two blanks before and one after."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))
