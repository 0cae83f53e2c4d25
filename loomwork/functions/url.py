"""URL checks and redaction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(url: Column, schemes: tuple[str, ...] = ("http", "https", "socks5", "socks5h")) -> Column:
    """A known scheme and a host are there."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin(*schemes) & url.rlike(r"\A[^:]+://[^/?#]+"), F.lit(False))


def redact(url: Column) -> Column:
    """Without user and password."""
    return F.regexp_replace(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"\A[^:]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
