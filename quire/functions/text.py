"""Column-level text functions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java class equal to Python's str.isspace on the basic plane.
WS = r"[\s\x1c-\x1f]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(x: Column, body) -> Column:
    """body(v) with v bound to the value of ``x``: it is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def trim_ws(x: Column | str) -> Column:
    """Strip Unicode white space on both sides; null stays null."""
    return F.regexp_replace(_c(x), rf"(?U)^{WS}+|{WS}+$", "")


def rtrim_ws(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), rf"(?U){WS}+$", "")


def ws_split(x: Column | str) -> Column:
    """Split at Unicode white space, without empty parts."""
    return F.filter(F.split(_c(x), rf"(?U){WS}+"), lambda t: t != "")


def clean_text(x: Column | str) -> Column:
    return F.array_join(ws_split(x), " ")


def tokens(x: Column | str) -> Column:
    """Maximal runs of a-z and 0-9 in the lower-cased text; null gives null."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9]+"), F.lit(0))


def long_tokens(x: Column | str, shortest: int = 3) -> Column:
    return F.filter(tokens(x), lambda t: F.length(t) >= shortest)


def letters_only(x: Column | str) -> Column:
    """Lower-cased text with anything but a-z made a single blank."""
    t = F.regexp_replace(F.lower(_c(x)), r"[^a-z\s]", " ")
    return trim_ws(F.regexp_replace(t, r"\s+", " "))


def ngrams(arr: Column, n: int) -> Column:
    """Sliding n-grams of an array joined by blanks; an empty array where it is too short."""
    gram = lambda i: F.array_join(F.slice(arr, i + 1, n), " ")
    return F.when(F.size(arr) >= n, F.transform(F.sequence(F.lit(0), F.size(arr) - n), gram)).otherwise(F.array().cast("array<string>"))


def sentences(x: Column | str) -> Column:
    """Split at white space after . ! or ? once white space is collapsed; no blanks."""
    return F.filter(F.split(clean_text(x), r"(?<=[.!?])\s+"), lambda s: s != "")


def first_sentences(x: Column | str, n: int) -> Column:
    """The first n (1 to 8) sentences; the first 500 characters where there is no sentence."""
    n = max(1, min(8, n))
    s = sentences(x)
    return F.when(F.size(s) == 0, F.substring(clean_text(x), 1, 500)).otherwise(F.array_join(F.slice(s, 1, n), " "))


def truncate(x: Column | str, most: int = 12000, marker: str = "\n\n[Truncated]") -> Column:
    """At most ``most`` characters, right-stripped, with a marker where something was cut."""
    most = most if most > 0 else 12000
    c = _c(x)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(rtrim_ws(F.substring(c, 1, most)), F.lit(marker)))


def or_default(x: Column | str, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))
