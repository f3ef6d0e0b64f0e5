"""Column expressions over text: all JVM-side, Unicode-aware where the semantics ask for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a sentence's content.
STOPWORDS = (
    "that this from into their there which when where what while have been being each only also than then "
    "them they over under about after before most more less such other some will would should could does "
    "your with these those very used uses using make made same both between within without because"
).split()
STEM = 6
WORD = r"[a-z][a-z-]{3,}"


def squash(c: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def spaced(c: Column) -> Column:
    """Lower case; squares and cubes as digits; one space for each run of anything but a-z and 0-9, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "²³", "23"), "[^a-z0-9]+", " "))


def strip_space(c: Column) -> Column:
    """Trim any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column, ascii_only: bool = False) -> Column:
    """Search tokens; letters and digits of any script, or of ASCII alone."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+" if ascii_only else r"[\p{L}\p{N}]+"), F.lit(0))


def strip_maths(c: Column) -> Column:
    """Remove formula spans and notes on marks."""
    c = F.regexp_replace(c, r"(?s)\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]", " ")
    return F.regexp_replace(c, r"(?i)\(\s*(?:\d+\s*|(?:one|two|three|half)\s+)marks?[^)]*\)", " ")


def content_stems(c: Column) -> Column:
    """Distinct six-letter stems of content words, stop words removed first."""
    words = F.regexp_extract_all(F.lower(strip_maths(c)), F.lit(WORD), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, STEM)))


def support(claim: Column, source: Column) -> Column:
    """Share of the claim's stems which the source has; 1 if there are fewer than three."""
    n = F.size(claim)
    return F.when(n < 3, 1.0).otherwise(F.size(F.array_intersect(claim, source)) / n)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(c: Column, stars: bool = False) -> Column:
    """Sentences; with ``stars`` (Markdown) one may begin with an asterisk too."""
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9*(])" if stars else r"(?<=[.!?])\s+(?=[A-Z0-9(])")


def content_id(content: Column) -> Column:
    """First 16 hex digits of the sha-256 of the bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def error_rate(a: Column, b: Column) -> Column:
    """Edit distance by the length of the expected text, at most 1."""
    return F.least(F.lit(1.0), F.levenshtein(a, b) / F.greatest(F.length(b), F.lit(1)))
