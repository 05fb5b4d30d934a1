"""Scalar forms used across dialects and in the service views."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_div(a: Column, b: Column) -> Column:
    """NULL instead of an error on division by zero."""
    return F.try_divide(a, b)


def if_null(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def iff(cond: Column, yes, no) -> Column:
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def minus_days(c: Column, days: int) -> Column:
    return c - F.expr(f"INTERVAL {int(days)} DAYS")


def score_band(valid: Column, score: Column) -> Column:
    """good from 80, mid from 50, else bad; an invalid text is always bad."""
    return F.when(~valid, "bad").when(score >= 80, "good").when(score >= 50, "mid").otherwise("bad")


def client_key(forwarded: Column, peer: Column) -> Column:
    """First element of a forwarded-for header, else the peer address, else ``unknown``."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.when(forwarded != "", first), peer, F.lit("unknown"))


def age_label(ts: Column, now: Column) -> Column:
    """Relative age of a check: minutes and hours within a day, else day and month."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    s = F.floor(seconds(now) - seconds(ts))
    return (
        F.when(s < 60, F.lit("just now"))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" hr ago")))
        .otherwise(F.date_format(ts, "d MMM"))
    )


def snippet(sql: Column, width: int = 60) -> Column:
    """One-line preview for the history list."""
    return F.substring(F.regexp_replace(sql, r"\s+", " "), 1, width)
