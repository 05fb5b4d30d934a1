"""Mixing sources to target weights by capped water-filling.

The budget is the sum of all sizes. Sources share it by weight; a source that would exceed ``epochs`` times its size is
clamped there, and the excess is dealt again by weight until no source is above. A source's target is then taken as whole
repetitions of all its documents and one fractional repetition: the documents that come first in a seeded order, the last
of them cut at the word where the target is met. So a source's taken words are its target, rounded down.

All sums are whole numbers, so reruns and other partitionings agree to the word. A source may hold any share of the rows:
its documents are ordered in range blocks, and only sums per block are combined. Only the two numbers of the water level reach
the driver, once per round; rounds end when no further source is clamped.

Defined cases: a null text has size 0, a document of size 0 takes 0; null is a source of its own, the last one; a null id
is ordered as the empty text; repeated rows stand next to each other in the order and are taken one by one; an empty
table gives no rows; a table without words has targets of 0. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from queryscope.llm.common import numbered_locally, with_rank
from queryscope.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_weights(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size, weight): the sources in code point order, null last, take the weights in turn."""
    order = F.col("source").asc_nulls_last()
    ranked = sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("_all", F.lit(0))
    ranked = with_rank(numbered_locally(ranked, "_all", ordered=True), "_all", "_rank", ordered=True)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return cut(ranked.select("source", "source_size", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).alias("weight")))


def fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Adds ``clamped``, ``level`` and ``share``: an open source's target is ``level * weight / share``, a clamped one's ``epochs`` sizes."""
    total, share = (int(x or 0) for x in sources.agg(F.sum(F.col("source_size").cast(BIG)), F.sum(F.col("weight").cast(BIG))).first())
    level, clamped = total, 0

    def number(x) -> Column:
        return F.lit(int(x)).cast(BIG)

    def above() -> Column:
        return number(epochs) * F.col("source_size") * number(share) < number(level) * F.col("weight")

    while share:
        full = F.when(above(), F.col("source_size").cast(BIG) * epochs)
        used, count, rest = sources.agg(F.sum(full), F.count(full), F.sum(F.when(~above(), F.col("weight").cast(BIG)))).first()
        if count == clamped:
            break
        level, share, clamped = total - used, rest, count
    return sources.select("*", above().alias("clamped"), number(level).alias("level"), number(share or 1).alias("share"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), taken (words, repetitions counted), whole (full repetitions)."""
    if not weights or min(weights) <= 0:
        raise ValueError("every source needs a positive weight")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw")))
    sources = fill(source_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), epochs)
    poured = F.col("level") * F.col("weight")
    sources = sources.select(
        F.col("source").alias("_s"),
        "source_size",
        F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(poured.cast("double") / F.col("share").cast("double")).alias("target"),
        F.when(F.col("clamped"), F.col("source_size") * epochs).otherwise(F.expr("(level * weight) div share")).cast("bigint").alias("words"),
    )
    order = [F.col("source"), F.col("draw"), F.col("id"), F.col("size")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("draw")
    rows = with_rank(numbered_locally(rows, "source", "size", ordered=True), "source", "before", "size", ordered=True)
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("bigint")
    part = F.greatest(F.lit(0), F.least("size", F.col("words") - F.col("whole") * F.col("source_size") - F.col("before")))
    out = rows.join(sources, F.col("source").eqNullSafe(F.col("_s"))).withColumn("whole", whole)
    taken = (F.col("whole") * F.col("size") + part).cast("bigint")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "whole")
