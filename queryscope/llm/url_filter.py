"""URL filtering by association rules, in DataFrame operations only.

Spark's FP-growth mines combinations of URL tokens that come with a bad label. Rules that reach the support and the
confidence are kept, a rule whose antecedent contains that of another kept rule is dropped, and the rest is an inverted
index (token -> rule). Tokens that cannot matter leave before the mining and tokens that always come together are mined as
one (``mine_classes``). A URL is blocked by the method if it has a token of every class of a rule; hits are counted per (URL, rule)
by a partially aggregated group over the distinct URLs, so a URL that fills a third of a table is matched once.

Hand-written rules of the form host/path override the method: a rule fits its host and all subdomains, if the path
starts with the rule's path; the longest wins.

Defined cases: null URL or one without ``://`` -> empty host and path, no tokens, no rule, ``allow``; repeated rows are
all returned; without labels no association rule exists and the method allows everything; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from queryscope.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the item that stands for a bad label; no token can be equal to it
BAD = "\u0000bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def document_of(url: Column) -> Column:
    """The number that ends the path (an extension or slashes may follow) as bigint; null where there is none or it is too large."""
    return F.regexp_extract(path_of(url), r"(?s)/([0-9]+)(?:\.[^/.]*)?/*$", 1).try_cast("bigint")


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host and its parent domains, path words, query keys; empty for null."""
    host = host_of(url)
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    words = F.transform(
        F.filter(F.split(path_of(url), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x)
    )
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    every = F.concat(F.array(F.concat(F.lit("s:"), scheme)), domains, words, keys)
    return F.when(url.contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mine_classes(labelled: DataFrame, url: str, bad: str, min_support: float, min_confidence: float, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """((rule, classes, confidence, support), (class, token)) from rows with a URL and a boolean label (null: not labelled).

    ``min_support`` is a share of the labelled rows, but at least ``min_rows`` rows. Three exact reductions keep long URLs
    from multiplying combinations: a token with too few bad rows is in no rule; a token that is a rule by itself is in no longer
    one, as that would be redundant; tokens that occur in exactly the same rows are one class, of which any member stands for all.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(bad).isNotNull()).select(tokens_of(F.col(url)).alias("t"), F.col(bad).alias("b")).where(F.size("t") > 0)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    none = spark.createDataFrame([], "rule bigint, classes array<string>, confidence double, support double")
    if not total:
        return none, spark.createDataFrame([], "class string, token string")
    least = max(min_support * total, min_rows) - 1e-9
    each = rows.select("row", "b", F.explode("t").alias("token"))
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("row")).cast("decimal(38,0)"))
    per = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("k"), mark(1).alias("x"), mark(2).alias("y"))
    per = cut(per.where(F.col("k") >= least).withColumn("confidence", F.col("k") / F.col("n")))
    alone = per.where(F.col("confidence") >= min_confidence)
    singles = alone.select(F.xxhash64("token").alias("rule"), F.array("token").alias("classes"), "confidence", (F.col("k") / total).alias("support"))
    open_ = per.where(F.col("confidence") < min_confidence)
    head = open_.groupBy("n", "x", "y").agg(F.min("token").alias("class"))
    members = cut(open_.join(head, ["n", "x", "y"]).select("class", "token"))
    both = members.unionByName(alone.select(F.col("token").alias("class"), "token"))
    items = each.join(members, "token").groupBy("row", "b").agg(F.collect_set("class").alias("t"))
    items = cut(items.select(F.when(F.col("b"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items")))
    count = items.count()
    if not count or least > count:
        return cut(singles), both
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, least) / count), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD)).select(
        F.array_sort("antecedent").alias("classes"), "confidence", (F.col("support") * (count / total)).alias("support")
    )
    rules = cut(rules.withColumn("rule", F.xxhash64(F.array_join("classes", "\u0001"))))
    # a rule is redundant if another rule's classes are a part of its own: an inverted join on classes, counted per pair
    short = rules.select(F.col("rule").alias("r"), F.size("classes").alias("n"), F.explode("classes").alias("class"))
    wide = rules.select("rule", F.size("classes").alias("m"), F.explode("classes").alias("class"))
    held = wide.join(short, "class").where("n < m").groupBy("rule", "r", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    kept = rules.join(held.select("rule").distinct(), "rule", "left_anti").select("rule", "classes", "confidence", "support")
    return cut(singles.unionByName(kept)), both


def mine_rules(labelled: DataFrame, url: str, bad: str, min_support: float, min_confidence: float, min_rows: int) -> DataFrame:
    """(rule, tokens, confidence, support): the rules spelled out, one for each choice of a member of every class."""
    rules, members = mine_classes(labelled, url, bad, min_support, min_confidence, min_rows)
    parts = rules.select("*", F.posexplode("classes").alias("at", "class")).join(members, "class")
    lists = parts.groupBy("rule", "confidence", "support", "at").agg(F.collect_list("token").alias("m"))
    lists = lists.groupBy("rule", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("l"))
    start = F.array(F.array().cast("array<string>"))
    spelled = F.aggregate("l", start, lambda acc, x: F.flatten(F.transform(acc, lambda done: F.transform(x["m"], lambda token: F.concat(done, F.array(token))))))
    return lists.select("rule", F.explode(spelled).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def matched_urls(pages: DataFrame, url: str, rules: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct URLs that have a token of every class of a rule, with the number of such rules (``n_rules``)."""
    index = rules.select("rule", F.size("classes").alias("need"), F.explode("classes").alias("class")).join(members, "class")
    urls = pages.where(F.col(url).contains("://")).select(F.col(url).alias("_u")).distinct()
    held = urls.select("_u", F.explode(tokens_of(F.col("_u"))).alias("token")).join(index, "token")
    hits = held.groupBy("_u", "rule", "need", "class").agg(F.lit(1)).groupBy("_u", "rule", "need").agg(F.count(F.lit(1)).alias("k")).where("k = need")
    return hits.groupBy("_u").agg(F.count(F.lit(1)).alias("n_rules"))


def listed_rule(host: Column, path: Column, allow: Sequence[str], block: Sequence[str]) -> tuple[Column, Column]:
    """(longest hand-written rule that fits, its verdict), both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, word in sorted([(r, "allow") for r in allow] + [(r, "block") for r in block], key=lambda x: (len(x[0]), x[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    bad: str = "bad",
    allow: Sequence[str] = (),
    block: Sequence[str] = (),
    min_support: float = 0.002,
    min_confidence: float = 0.5,
    min_rows: int = 20,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, n_rules (association rules that matched)."""
    rules, members = mine_classes(labelled, url, bad, min_support, min_confidence, min_rows)
    hits = matched_urls(pages, url, rules, members)
    rows = pages.select(F.col(id_col), F.col(url).alias("_url")).join(hits, F.col("_url") == F.col("_u"), "left")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
    rule, listed = listed_rule(F.col("host"), F.col("path"), allow, block)
    method = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(listed, method).alias("verdict"), "n_rules")
