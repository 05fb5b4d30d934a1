"""The pipeline against a brute-force version of each stage."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from queryscope.llm import langid, packing, quality
from queryscope.llm.common import fold
from tests.llm.conftest import plain_words
from tests.llm.test_text_operators import components, shingles

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9) if w else 0)}
    now = docs
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [5, 5, 5, 5, 7]):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        after = stage(spark, now, SMALL).cache()
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert len(after.columns) == columns and (columns != 5 or after.columns == docs.columns)
        if name == "quality_classifier":
            x = np.array([quality.features(before[i]) for i in sorted(before) if i in labels])
            y = np.array([labels[i] for i in sorted(before) if i in labels], float)
            model = quality.fit_arrays(x, y)
            assert left == {i for i, t in before.items() if model.score(quality.features(t or "")[None])[0] >= quality.THRESHOLD}
            assert {i for i in before if labels.get(i) == 1} <= left and not {i for i in before if labels.get(i) == 0} & left
        elif name == "language_id":
            assert left == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "minhash_near_dedup":
            assert left == {i for i, c in components({i: shingles(t) for i, t in before.items()}, corpus_pipeline.NEAR).items() if i == c}
        elif name == "benchmark_decontamination":
            words = {i: plain_words(t) for i, t in before.items()}
            sizes = {len(x) for x in windows}
            hit = {i for i, w in words.items() if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
            assert hit and left == set(before) - hit
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            size = {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
            got = after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
            assert {r["doc_id"]: r["n"] for r in got} == size
            stock = Counter(r["length"] for r in after.collect())
            used = after.select("sequence_id").distinct().count()
            assert packing.lower_bound(dict(stock), 4096) <= used <= sum(n for _, n in packing.best_fit(dict(stock), 4096))
        now = after


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for table, rows in ((odd_docs, None), (no_docs, 0)):
        folder = str(tmp_path / f"t{rows}")
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(5, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert rows is None or out.count() == rows
            out.count()
        assert corpus_pipeline.run(spark, folder).count() >= (rows or 0)


def test_language_stage_rejects_what_the_model_does_not_know(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = np.random.default_rng(6)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(60)) for _ in range(10)]
    strange = [
        "Жили были старик со старухой у самого синего моря", "漢字かな交じり文を書きます", "Ὅλοι οἱ ἄνθρωποι γεννιοῦνται ἐλεύθεροι",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "minden emberi lény szabadon születik és egyenlő méltósága és joga van", "12 34 !!", "", None,
    ]
    rows = [(10_000_000 + i, t, "en", "s", 0) for i, t in enumerate(junk)] + [(20_000_000 + i, t, None, "s", 0) for i, t in enumerate(strange)]
    planted = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    left = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, planted, SMALL).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_language_stage_keeps_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    got = langid.identify(docs.where(held), langid.fit(docs.where(~held)), ["doc_id", "text"], evidence=True).collect()
    assert got and all(r["evidence"] >= corpus_pipeline.EVIDENCE for r in got if any(c.isalpha() for c in r["text"] or ""))
