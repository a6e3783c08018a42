"""Cleaning, validity and character n-gram expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space that a text may hold, as a Java character class.
WHITE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
# Fixed value: modulus of the gram hash and of the MinHash permutations (2^31 - 1).
PRIME = 2147483647


def clean(text: Column) -> Column:
    """Lower-case, trim and reduce runs of white space to one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WHITE_SPACE, " "))


def is_valid(cleaned: Column) -> Column:
    """At least two code points and not digits only."""
    return (F.length(cleaned) >= 2) & ~cleaned.rlike(r"^\p{Nd}+$")


def _windows(text: Column, pattern: str) -> Column:
    # The look-ahead captures a gram at each code point, so the text is walked once per length.
    return F.regexp_extract_all(text, F.lit(f"(?=({pattern}))."), F.lit(1))


def all_grams(cleaned: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """Every substring of n_min..n_max code points, repeats included."""
    return F.flatten(F.array(*[_windows(cleaned, f".{{{n}}}") for n in range(n_min, n_max + 1)]))


def gram_set(cleaned: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """Distinct grams; a text shorter than ``n_min`` gives its distinct characters instead."""
    short = F.length(cleaned) < n_min
    return F.array_distinct(
        F.when(short, F.split(cleaned, "")).otherwise(all_grams(cleaned, n_min, n_max))
    )


def word_grams(cleaned: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """Grams inside single words padded with one space on each side, repeats included."""
    padded = F.concat(F.lit(" "), cleaned, F.lit(" "))
    return F.flatten(
        F.array(*[_windows(padded, f".[^ ]{{{n - 2}}}.") for n in range(n_min, n_max + 1)])
    )


def gram_hash(gram: Column) -> Column:
    """First 32 bits of the SHA-1 of the UTF-8 bytes, below PRIME."""
    head = F.substring(F.sha1(gram.cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(PRIME)
