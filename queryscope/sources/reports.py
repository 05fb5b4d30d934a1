"""Readable reports. A review is a set of ordered parts, never one collected string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from queryscope.operators.findings import gate, review_totals
from queryscope.session import cut

MARK = {"high": "🔴", "medium": "🟡", "low": "🔵"}


def _badge(sev: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in MARK.items() for x in (F.lit(k), F.lit(v))]), sev)


def _with_hint(results: DataFrame) -> DataFrame:
    return results if "hint" in results.columns else results.withColumn("hint", F.lit(None).cast("string"))


def review_report(results: DataFrame, review: str, path: str, threshold: str = "never", marker: str = "<!-- sql-review -->") -> DataFrame:
    """review, part, path, body: header, one section per file with something to say, footer.

    Sorted by (part, path) the bodies of a review form its markdown. A section
    holds at most one line per title, so every row stays small however many
    files a review has.
    """
    c = F.col
    # three parts read the results; lint once
    results = cut(_with_hint(results).select(review, path, "valid", "score", "findings", "error", "error_line", "hint"))
    totals = review_totals(results, review)
    clean = (c("finding_count") == 0) & (c("syntax_errors") == 0)
    summary = F.when(
        clean, F.concat(F.lit("Nothing to report in "), c("files"), F.lit(" reviewed file(s)."))
    ).otherwise(
        F.concat(
            F.lit("Files: "), c("files"), F.lit(", unreadable: "), c("syntax_errors"), F.lit(", findings: "), c("finding_count"), F.lit("."),
        )
    )
    header = totals.select(
        review, F.lit(0).alias("part"), F.lit("").alias("path"), F.concat_ws("\n", F.lit(marker), F.lit("## SQL review"), F.lit(""), summary).alias("body")
    )
    line = lambda x: F.concat(F.lit("- "), _badge(x["severity"]), F.lit(" **"), x["title"], F.lit("** ("), x["severity"], F.lit(") — "), x["message"])
    where = F.when(c("error_line").isNotNull(), F.concat(F.lit(" (line "), c("error_line"), F.lit(")"))).otherwise("")
    bad = F.concat(F.lit("### ❌ `"), c(path), F.lit("` — syntax error\n"), c("error"), where, F.coalesce(F.concat(F.lit("\nHint: "), c("hint")), F.lit("")))
    good = F.concat_ws(
        "\n",
        F.concat(F.lit("### `"), c(path), F.lit("` — score "), c("score"), F.lit("/100")),
        F.array_join(F.transform("findings", line), "\n"),
    )
    files = results.where(~c("valid") | (F.size(F.coalesce("findings", F.array())) > 0)).select(
        review, F.lit(1).alias("part"), c(path).alias("path"), F.when(c("valid"), good).otherwise(bad).alias("body")
    )
    blocked = gate(results, threshold).groupBy(review).agg(F.bool_or("blocked").alias("b"))
    stop = F.when(c("b"), F.concat(F.lit("\n\nNot to be merged: a file cannot be read, or a finding of severity "), F.lit(threshold), F.lit(" or above is open.")))
    if threshold == "never":
        stop = F.lit(None).cast("string")
    footer = blocked.select(review, F.lit(2).alias("part"), F.lit("").alias("path"), F.concat(F.lit(marker), F.coalesce(stop, F.lit(""))).alias("body"))
    return header.unionByName(files).unionByName(footer)


def text_report(results: DataFrame, path: str) -> DataFrame:
    """path, report: the plain-text report of each file."""
    c, results = F.col, _with_hint(results)
    line = lambda x: F.concat(F.lit("  ["), F.rpad(F.upper(x["severity"]), 6, " "), F.lit("] "), x["title"], F.lit(" — "), x["message"])
    head = F.concat(F.lit("=== "), c(path), F.lit(" ==="))
    found = F.when(F.size("findings") > 0, F.array_join(F.transform("findings", line), "\n")).otherwise("  clean, no findings")
    muted = F.when(F.size("suppressed") > 0, F.concat(F.lit("  suppressed by noqa: "), F.array_join("suppressed", ", ")))
    ok = F.concat_ws("\n", head, F.concat(F.lit("  score: "), c("score"), F.lit("/100")), found, muted)
    err = F.concat_ws("\n", head, F.concat(F.lit("  SYNTAX ERROR (line "), F.coalesce(c("error_line").cast("string"), F.lit("?")), F.lit("): "), c("error")), F.concat(F.lit("  hint: "), c("hint")))
    return results.select(c(path).alias("path"), F.when(c("valid"), ok).otherwise(err).alias("report"))
