"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
#: Letters with diacritics and their base letters.
ACCENTED = "àâäáãçéèêëíîïìñóôöòõúùûüÿ"
PLAIN = "aaaaaceeeeiiiinooooouuuuy"
TOKEN = r"([\p{L}\p{N}\p{Co}]+)"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\x0B\x0C]+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^ \t\n\r\x0B\x0C]+")).cast("long")


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def terms(c: Column) -> Column:
    """Search terms of a text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(1))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty."""
    n = F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.when(x == "", F.lit(0.0)).otherwise(-share(x) * F.log2(share(x))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) + F.lit(0.0))


def nearest_rank(values: Column, p: int) -> Column:
    """Element at min(floor(n p / 100), n - 1) of the sorted array; 0 for none."""
    n = F.size(values)
    at = F.least(F.floor(n * F.lit(p) / 100).cast("int"), n - 1) + 1
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(values), at))


def preview(c: Column, n: int = 200) -> Column:
    """First n characters, with "..." where more follow."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
