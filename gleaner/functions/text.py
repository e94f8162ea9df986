"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\p{N}+|\p{L}[\p{L}\p{N}]*"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, also where ``f`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokenize(text: Column) -> Column:
    """Runs of digits, or of letters and digits led by a letter; lower case, two characters at least."""
    runs = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(runs, F.lower), lambda t: F.length(t) >= 2)


def collapse(text: Column) -> Column:
    """Blanks collapsed to one and trimmed; NULL is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def shingle_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zäöüß0-9]+"), F.lit(0))


def runs(words: Column, size: int = 3) -> Column:
    """Overlapping runs of ``size`` words joined by a blank; the words themselves where there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
    return bind(words, lambda w: F.when(F.size(w) < size, w).otherwise(runs(w)))


def shingles(text: Column, size: int = 3) -> Column:
    """``runs`` of the words of a text."""
    return runs(shingle_words(text), size)


def page_snippet(description: Column, h1: Column, text: Column, limit: int = 700) -> Column:
    """Description, heading unless the description holds it, text; collapsed and cut."""
    d, h = F.coalesce(description, F.lit("")), F.trim(F.coalesce(h1, F.lit("")))
    heading = F.when((h != "") & ~F.contains(d, h), h)
    return F.substring(collapse(F.concat_ws(" ", F.nullif(d, F.lit("")), heading, text)), 1, limit)


def hit_snippet(terms: Column, position: Column, context: int = 20) -> Column:
    """The terms around a 0-based position, with dots where it is clipped; the first 40 terms without one."""
    start, end, n = F.greatest(F.lit(0), position - context), F.least(F.size(terms), position + context + 1), F.size(terms)
    body = F.array_join(F.slice(terms, start + 1, end - start), " ")
    clipped = F.concat(F.when(start > 0, "... ").otherwise(""), body, F.when(end < n, " ...").otherwise(""))
    return F.when(position.isNull(), F.array_join(F.slice(terms, 1, 40), " ")).otherwise(clipped)


def has_topic(text: Column, pattern: str) -> Column:
    return F.lower(text).rlike(pattern)


def topic_hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(pattern))


def flag(name: str, on: Column) -> Column:
    return F.when(on, f"{name}:yes").otherwise(f"{name}:no")


def bucket(value: Column, step: float) -> Column:
    """Rounded half to even to a multiple of ``step``, two decimals; 'missing' for NULL."""
    v = F.bround(value.cast("double") / F.lit(step), 0) * F.lit(step)
    return F.when(value.isNull(), "missing").otherwise(F.format_string("%.2f", v))


def optional_int(value: Column, zero_is_missing: bool = True) -> Column:
    """Whole number of a text or number, by way of a float; blank, other text and (by default) 0 are NULL."""
    v = F.trim(value.cast("string")).try_cast("double")
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
    return F.nullif(whole, F.lit(0).cast("long")) if zero_is_missing else whole


def optional_float(value: Column, zero_is_missing: bool = True) -> Column:
    v = F.trim(value.cast("string")).try_cast("double")
    return F.nullif(v, F.lit(0.0)) if zero_is_missing else v


def optional_bool(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")
