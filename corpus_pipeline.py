"""From raw documents to packed training sequences: five stages, each one operator of ``queryscope.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a stage's rows as Parquet in the shared
checkpoint folder and reads them back as the next stage's documents. All but the last return the documents' own columns,
whatever others they carry.

Defined cases: an empty table passes through as an empty table; null and empty texts have no letters and leave at the
language stage at the latest; repeated rows are judged alike, and near-dedup keeps one row of each group, repeated rows and
rows without id included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from queryscope.llm import decontaminate, langid, minhash, packing, quality
from queryscope.llm.common import prepare
from queryscope.llm.queries import vocabulary
from queryscope.session import ensure_checkpoint_dir

#: similarity in percent from which documents of the pipeline are near copies
NEAR = 80
#: evidence (``queryscope.llm.langid``) from which a document stays at the language stage. All held-out documents of the given tables are
#: above (least: -1.90 at sf0.1); sentences in unlearned languages or scripts and random letters are below -3
EVIDENCE = -2.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts above the quality cut; it learns from all labelled documents of the stage's input."""
    prepare(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*DOCUMENT), model, DOCUMENT).where("predicted = 1").select(*DOCUMENT)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters are evidence for a language of the stage's input; unlearned ones, junk and texts without a letter go."""
    prepare(spark)
    model = langid.fit(docs)
    scored = langid.identify(docs.select(*DOCUMENT), model, DOCUMENT, evidence=True)
    return scored.where((F.col("lang_pred") != "und") & (F.col("evidence") >= EVIDENCE)).select(*DOCUMENT)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Rows of a repeated id are one group, of which the least row stays; a row without id stays if no row with one has its like.
    """
    prepare(spark)
    rows = docs.select(*DOCUMENT).withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(1 << 62) + F.monotonically_increasing_id()))
    gone = minhash.near_duplicates(rows, "_id", percent=NEAR).where(~F.col("kept")).select("_id").distinct()
    again = rows.groupBy("_id").count().where("count > 1").select("_id")
    left = rows.join(gone, "_id", "left_anti")
    once = left.join(again, "_id", "left_anti").select(*DOCUMENT)
    one = left.join(again, "_id", "left_semi").groupBy("_id").agg(F.min(F.struct(*DOCUMENT)).alias("r")).select("r.*")
    return once.unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_hits(docs, benchmark, DOCUMENT).where(F.size("hit_words") == 0).select(*DOCUMENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 4096 tokens."""
    prepare(spark)
    pieces = packing.pieces(docs, vocabulary(), ["doc_id"])
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL has no pairwise ranking or packing search; tests/llm/test_pipeline.py compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
