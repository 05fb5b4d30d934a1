"""From rule hits to results: suppression, score, order, gates, totals and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from queryscope.functions import words as K
from queryscope.functions.scalars import score_band
from queryscope.operators import rules as R
from queryscope.plans import tokens as T
from queryscope.session import cut

NOQA_RX = r"(?is)^\s*noqa\s*(?::\s*(.*))?\s*$"


def severity_weight(sev: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in K.SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))]), sev)


def severity_rank(sev: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in K.SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))]), sev)


def dedupe_findings(f: DataFrame, key: str = "query_id") -> DataFrame:
    """One finding per (query, title); the first in rule order keeps its message."""
    rest = [c for c in f.columns if c not in (key, "title")]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in ("rule_no", "pos") if c in f.columns]))
    return f.groupBy(key, "title").agg(first.alias("_r")).select(key, "title", "_r.*")


def noqa_directives(texts: DataFrame) -> DataFrame:
    """tid, suppress_all, titles (lower case) from the comments of each text."""
    c = T.comments(texts.where(F.lower("sql").contains("noqa")))
    hit = c.where(F.col("body").rlike(NOQA_RX))
    listed = F.trim(F.regexp_extract("body", NOQA_RX, 1))
    titles = F.filter(F.transform(F.split(F.lower(listed), ","), F.trim), lambda x: x != "")
    return hit.groupBy("tid").agg(
        F.bool_or(listed == "").alias("suppress_all"),
        F.array_distinct(F.flatten(F.collect_list(F.when(listed != "", titles)))).alias("titles"),
    )


def noqa_of(sql: Column, dialect: Column) -> Column:
    """(suppress_all, titles) of a text's own comments, null where it has no directive: ``noqa_directives`` without a second pass over the texts."""
    rx = F.lit(NOQA_RX)
    cut_ = F.transform(T.tokens(sql, dialect), T.bare)
    body = F.transform(F.filter(cut_, lambda c: T.is_comment(c, dialect)), T.comment_body)
    listed = F.transform(F.filter(body, lambda b: F.regexp_like(b, rx)), lambda b: F.trim(F.regexp_extract(b, NOQA_RX, 1)))
    names = lambda x: F.filter(F.transform(F.split(F.lower(x), ","), F.trim), lambda n: n != "")
    found = F.struct(
        F.exists(listed, lambda x: x == "").alias("suppress_all"), F.array_distinct(F.flatten(F.transform(F.filter(listed, lambda x: x != ""), names))).alias("titles")
    )
    return F.when(F.lower(sql).contains("noqa"), found)


def apply_noqa(f: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings with a ``suppressed`` flag; directives reach the whole query."""
    d = noqa_directives(texts)
    named = F.coalesce(F.array_contains("titles", F.lower("title")), F.lit(False))
    return f.join(d, "tid", "left").withColumn(
        "suppressed", F.coalesce(F.col("suppress_all"), F.lit(False)) | named
    ).drop("suppress_all", "titles")


def score(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.coalesce(penalty, F.lit(0)))


def check_texts(
    texts: DataFrame, titles: Sequence[str] | None = None, catalog: DataFrame | None = None, with_hints: bool = False
) -> DataFrame:
    """One result row per distinct text: validity, score, ordered findings, suppressed titles, and a hint if asked for.

    An invalid text has no findings and no score; nothing suppresses its error.
    """
    c = F.col
    j = R.text_results(R.linted(texts, titles, "sql"), titles, "sql", "dialect")
    none = F.array().cast("array<struct<rule_no:int,severity:string,title:string,message:string>>")
    hits = F.coalesce("hits", none)
    if catalog is not None:
        more = R.catalog_findings(T.statements(T.whole(texts), (), ["cols", "ctes", "tabs"]), catalog, titles)
        if more is not None:
            j = j.join(more, "tid", "left")
            hits = F.concat(hits, F.coalesce("more", none))
    j = j.withColumn("noqa", noqa_of(c("sql"), c("dialect")))
    quiet = lambda x: F.coalesce("noqa.suppress_all", F.lit(False)) | F.coalesce(F.array_contains("noqa.titles", F.lower(x["title"])), F.lit(False))
    rank = lambda x: F.struct((F.lit(2) - severity_rank(x["severity"])).alias("order"), x["rule_no"], x["severity"], x["title"], x["message"])
    j = j.withColumn("_hits", hits)
    j = j.withColumn("_open", F.array_sort(F.transform(F.filter("_hits", lambda x: ~quiet(x)), rank)))
    j = j.withColumn("_quiet", F.array_sort(F.transform(F.filter("_hits", quiet), lambda x: F.struct(x["rule_no"], x["title"]))))
    if with_hints:
        j = R.with_hint(j)
    penalty = F.aggregate("_open", F.lit(0), lambda acc, x: acc + severity_weight(x["severity"]))
    shown = F.transform("_open", lambda x: F.struct(x["severity"].alias("severity"), x["title"].alias("title"), x["message"].alias("message")))
    valid = F.coalesce(c("valid"), F.lit(False))
    return j.select(
        "tid",
        valid.alias("valid"),
        F.when(valid, score(penalty)).cast("int").alias("score"),
        F.when(valid, shown).alias("findings"),
        F.when(valid, F.transform("_quiet", lambda x: x["title"])).alias("suppressed"),
        F.when(valid, c("statement_count")).alias("statement_count"),
        F.when(~valid, F.coalesce(c("kind"), F.lit("empty statement"))).alias("error"),
        F.when(~valid, c("line")).alias("error_line"),
        F.when(~valid, F.expr("length(substring_index(substring(sql, 1, at), '\\n', -1)) + 1")).alias("error_column"),
        *([c("hint")] if with_hints else []),
    )


def lint_corpus(
    log: DataFrame,
    titles: Sequence[str] | None = None,
    catalog: DataFrame | None = None,
    dbt_mode: bool = False,
    partitions: int | None = None,
    with_hints: bool = False,
) -> DataFrame:
    """Every log row with the result of its text; each distinct text is linted once.

    Texts of any length are linted; an empty or null text gets a row with an error.
    """
    keyed = T.normalise_log(log, dbt_mode)
    res = check_texts(T.distinct_texts(keyed, partitions), titles, catalog, with_hints)
    # one row per text on the right: run-time skew handling splits a hot text on the left
    return keyed.join(res, "tid", "inner")


def findings_of(results: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per finding of each result row."""
    # outer: the filter that the optimizer puts below a plain generator would make the findings twice
    return results.select(*keys, F.inline_outer("findings")).where("title IS NOT NULL")


def lint_findings(log: DataFrame, titles: Sequence[str] | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """query_id, severity, title, message of the whole log: the findings of valid texts that no comment suppresses."""
    return findings_of(lint_corpus(log, titles, catalog), "query_id")


# ---- gates and totals -------------------------------------------------------


def worst(findings: Column) -> Column:
    return F.array_max(F.transform(findings, lambda x: severity_rank(x["severity"])))


def gate(results: DataFrame, threshold: str) -> DataFrame:
    """``blocked``: a finding at or above the threshold; an invalid text always fails. ``never`` blocks nothing else."""
    if threshold != "never" and threshold not in K.SEVERITY_RANK:
        raise ValueError(f"unknown threshold {threshold}")
    hit = F.lit(False) if threshold == "never" else F.coalesce(worst(F.col("findings")) >= K.SEVERITY_RANK[threshold], F.lit(False))
    return results.withColumn("blocked", ~F.col("valid") | hit)


def review_totals(results: DataFrame, *keys: str) -> DataFrame:
    """Files, syntax errors, findings and the worst severity per review."""
    w = F.max(worst(F.col("findings")))
    return results.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.count_if(~F.col("valid")).alias("syntax_errors"),
        F.coalesce(F.sum(F.size(F.coalesce("findings", F.array()))), F.lit(0)).cast("bigint").alias("finding_count"),
        F.when(w == 2, "high").when(w == 1, "medium").when(w == 0, "low").otherwise("none").alias("worst"),
    )


def with_band(results: DataFrame) -> DataFrame:
    return results.withColumn("band", score_band(F.col("valid"), F.col("score")))


def finding_rollup(results: DataFrame, *keys: str) -> DataFrame:
    """Findings by ``keys`` with subtotals (ROLLUP); ``grouping`` tells the level.

    Text-level findings are counted per key before the rollup multiplies rows.
    """
    f = findings_of(results, "tid", *[k for k in keys if k not in ("title", "severity")])
    cells = f.groupBy(*keys).agg(F.count("*").alias("n"))
    return cells.rollup(*keys).agg(F.sum("n").alias("findings"), F.grouping_id().cast("bigint").alias("grouping"))


def finding_cube(results: DataFrame, *keys: str, person: str = "author") -> DataFrame:
    """Findings by every combination of ``keys`` (CUBE): exact counts, and sketched numbers of distinct texts and people.

    Cells are counted and sketched per key first; the cube then merges counts and HyperLogLog sketches of a few kB, so distinct
    numbers need no second pass over the findings and no expansion of texts.
    """
    f = findings_of(results, "tid", person, *[k for k in keys if k not in ("title", "severity")])
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(14))
    cells = f.groupBy(*keys).agg(F.count("*").alias("n"), sketch("tid").alias("t"), sketch(F.col(person).cast("string")).alias("p"))
    size = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return cells.cube(*keys).agg(
        F.sum("n").alias("findings"), size("t").alias("texts"), size("p").alias("people"), F.grouping_id().cast("bigint").alias("grouping")
    )


def title_shares(results: DataFrame) -> DataFrame:
    """Per title: queries hit and their share of all valid queries."""
    results = cut(results.select("query_id", "valid", "findings"))  # read twice
    total = results.agg(F.count_if("valid").alias("total"))
    hits = findings_of(results, "query_id").groupBy("title", "severity").agg(F.count("*").alias("queries"))
    # both sides hold at most one row per title, so they fit one array
    both = hits.unionByName(total, allowMissingColumns=True)
    one = both.agg(
        F.collect_list(F.when(F.col("title").isNotNull(), F.struct("title", "severity", "queries"))).alias("h"),
        F.max("total").alias("total"),
    )
    return one.select("total", F.inline("h")).select(
        "title", "severity", "queries", F.round(F.col("queries") * F.lit(100.0) / F.col("total"), 4).alias("share_pct")
    )


def fixable(results: DataFrame, *keys: str) -> DataFrame:
    """Findings an automatic fix exists for; suppressed ones are not among the findings any more."""
    return findings_of(results, *keys).where(F.col("title").isin(K.FIXABLE)).select(*keys, "title")
