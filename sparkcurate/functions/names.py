"""Name and text normalisers. Each caller picks one; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b"

# Words left out of the content tokens of a description.
STOPWORDS = ["of", "the", "a", "an", "with", "on", "in", "at", "to", "for"]


def clean(c: Column) -> Column:
    """Strip white space at both ends; null becomes the empty string."""
    return F.coalesce(F.btrim(c, F.lit(WHITESPACE)), F.lit(""))


def lower_name(c: Column) -> Column:
    """Strip and lower-case."""
    return F.lower(clean(c))


def squeezed_name(c: Column) -> Column:
    """Strip, lower-case, and squeeze inner white space to one space."""
    return F.regexp_replace(lower_name(c), r"\s+", " ")


def word_key(c: Column) -> Column:
    """Lower-case words of letters and digits, parted by single spaces."""
    return F.btrim(F.regexp_replace(lower_name(c), "[^a-z0-9]+", " "), F.lit(" "))


def label_key(c: Column) -> Column:
    """Underscores count as spaces; lower-case; squeezed."""
    return F.btrim(F.regexp_replace(F.lower(F.replace(clean(c), F.lit("_"), F.lit(" "))), r"\s+", " "), F.lit(" "))


def slug(c: Column, max_len: int = 80) -> Column:
    """File-name-safe form: other characters become ``_``; never empty."""
    body = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(body, 1, max_len), F.lit("")), F.lit("unnamed"))


def underscored(c: Column) -> Column:
    """Strip, and turn each run of white space into one underscore."""
    return F.regexp_replace(clean(c), r"\s+", "_")


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def content_tokens(c: Column) -> Column:
    """Tokens without the stop words."""
    return F.array_except(tokens(c), F.array(*[F.lit(w) for w in STOPWORDS]))


def sanitise(c: Column) -> Column:
    """Squeeze white space, then strip spaces and light punctuation at both ends."""
    return F.btrim(F.regexp_replace(clean(c), r"\s+", " "), F.lit(" ,.;:"))
