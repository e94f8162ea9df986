"""URL functions: column expressions, and Arrow functions where a relative link must be resolved."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.config import LinkGate, LinkSkip
from gleaner.functions.text import bind


def part(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))


def normalize_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", "")


def host_of(url: Column) -> Column:
    return normalize_host(part(url, "HOST"))


def path_of(url: Column) -> Column:
    """Percent-decoded lower-case path; a plus sign stays one."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(part(url, "PATH"), F.lit("+"), F.lit("%2B"))), part(url, "PATH")))


def path_text(url: Column) -> Column:
    return F.array_join(F.filter(F.split(path_of(url), r"[/_.:\-]+"), lambda p: p != ""), " ")


def segments(url: Column) -> Column:
    return F.filter(F.split(part(url, "PATH"), "/"), lambda p: p != "")


def strip_scheme(url: Column) -> Column:
    return F.trim(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"))


def url_slug(url: Column) -> Column:
    """A file-name stem of at most 90 characters from path and query."""
    path, q = F.trim(part(url, "PATH"), F.lit("/")), part(url, "QUERY")
    s = F.concat(F.when(path == "", "index").otherwise(path), F.when(q != "", F.concat(F.lit("-"), q)).otherwise(""))
    s = F.lower(F.trim(F.translate(s, "/?&=:@%#", "--------"), F.lit("-._")))
    s = F.when(F.length(s) > 90, F.trim(F.substring(s, 1, 90), F.lit("-._"))).otherwise(s)
    return F.when(s == "", "page").otherwise(s)


def saved_path(host: Column, url: Column) -> Column:
    """Where a body is kept: host, eight digits of the url's digest, slug."""
    return F.concat(host, F.lit("/"), F.substring(F.sha2(url, 256), 1, 8), F.lit("-"), url_slug(url), F.lit(".html"))


def url_family(url: Column, languages: tuple[str, ...] = LinkGate().languages) -> Column:
    """host, first segment, and the second where the first is a language: one string."""
    s = segments(url)
    first, second = F.lower(F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(""))), F.lower(F.coalesce(F.try_element_at(s, F.lit(2)), F.lit("")))
    return F.concat_ws("|", host_of(url), first, F.when(first.isin(*languages), second).otherwise(""))


def _any(words: tuple[str, ...]) -> str:
    return "(" + "|".join(re.escape(w) for w in words) + ")" if words else "(?!)"


def is_skippable(url: Column, skip: LinkSkip = LinkSkip()) -> Column:
    """Blocked host, resource suffix, foreign first segment or a skip word in the path."""
    blocked = bind(host_of(url), lambda h: h.isin(*skip.hosts) | h.rlike(_any(skip.host_suffixes) + "$"))
    resource = F.lower(url).rlike(_any(skip.suffixes) + "$")
    in_path = f"^/*{_any(skip.languages)}([/_-]|$)|(?<![a-z]){_any(skip.path_words)}(?![a-z])"
    return blocked | resource | path_of(url).rlike(in_path)


def canonical_absolute(url: Column) -> Column:
    """Canonical form of an absolute url, NULL where it has none: scheme, lower-case authority, path without a last slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(scheme.isin("http", "https") & (authority != ""), F.concat(scheme, F.lit("://"), authority, path))


def _canonical(raw: str | None, base: str | None) -> str | None:
    try:
        u = urlsplit(urljoin(base or "", raw or ""))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
    except ValueError:
        return None
    head, slash, last = u.path.rpartition("/")
    path = head + slash + last.partition(";")[0]
    return urlunsplit((u.scheme, u.netloc.lower(), path if path == "/" else path.rstrip("/"), "", ""))


@F.pandas_udf(StringType())
def canonical_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Canonical form of a link found on ``base``, NULL where it has none."""
    return pd.Series([_canonical(r, b) for r, b in zip(raw, base)], dtype=object)


def _normalized(url: str | None) -> str | None:
    if url is None:
        return None
    u = urlsplit(url.strip())
    scheme, netloc = u.scheme.lower() or "https", u.netloc.lower()
    default = {"http": ":80", "https": ":443"}.get(scheme, "")
    if default and netloc.endswith(default):
        netloc = netloc[: -len(default)]
    head, slash, last = (u.path or "/").rpartition("/")
    path = head + slash + last.partition(";")[0]
    query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True)))
    return urlunsplit((scheme, netloc, path if path == "/" else path.rstrip("/"), query, ""))


@F.pandas_udf(StringType())
def normalized_url(url: pd.Series) -> pd.Series:
    """The key of a search result: default scheme and ports dropped, query sorted, fragment gone."""
    return pd.Series([_normalized(u) for u in url], dtype=object)
