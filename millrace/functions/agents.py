"""Product tokens of a User-Agent header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: product/version with an optional comment in parentheses.
TOKEN = r"[A-Za-z0-9\-]+/[0-9\.]+(?: \([^\)]+\))? ?"


def _found(agent: Column) -> Column:
    """Token texts in header order; one pass of the pattern, parts are then cut at fixed characters."""
    return F.regexp_extract_all(F.coalesce(agent, F.lit("")), F.lit(TOKEN), F.lit(0))


def _product(token: Column) -> Column:
    return F.substring_index(token, "/", 1).alias("product")


def _version(token: Column) -> Column:
    return F.substring_index(F.substring_index(token, " ", 1), "/", -1).alias("version")


def agent_tokens(agent: Column) -> Column:
    """``array<struct<product, version, comment>>``; a NULL header has no tokens."""

    def parts(token: Column) -> Column:
        opened = F.substring_index(token, ")", 1)
        comment = F.substring(opened, F.locate("(", opened) + 1, F.length(opened))
        return F.struct(_product(token), _version(token), F.when(F.contains(token, F.lit("(")), comment).alias("comment"))

    return F.transform(_found(agent), parts)


def agent_products(agent: Column) -> Column:
    """``array<struct<product, version>>``, for those who only count versions."""
    return F.transform(_found(agent), lambda token: F.struct(_product(token), _version(token)))
