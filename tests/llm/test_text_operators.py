"""Corpus operators on texts against brute force, and their defined cases."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from queryscope.llm import decontaminate, eliasfano, langid, minhash, ngram, packing, quality, sharding, tokencount
from queryscope.llm.wordhash import WHITE, slices
from tests.llm.conftest import plain_words, sentence, white_words

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


# word hashes


def test_words_and_hashes(odd_texts):
    import pyarrow as pa

    got, names = [], {}
    for i, j, w in slices(pa.array(odd_texts, pa.string()), WHITE, limit=1000):
        for k in range(j - i):
            own = [w.word(x).decode() for x in range(w.first[k], w.first[k + 1])]
            got.append(own)
            for x, h in zip(own, w.hashes[w.first[k] : w.first[k + 1]]):
                assert names.setdefault(x, h) == h
    assert got == [white_words(t) for t in odd_texts]
    assert len(set(names.values())) == len(names)


# 2 language identification


def test_language_learns_and_backs_off(spark):
    rows = [(i, ("the house and the river " if i % 2 else "das haus und der fluss ") * 3, "en" if i % 2 else "de") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    tests = [(1, "the river"), (2, "der fluss"), (3, "theo houses"), (4, "Hausen unden"), (5, None), (6, "12 !!"), (7, "漢字"), (8, "")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 9)] == ["en", "de", "en", "de", "und", "und", "de", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["score"] == 0 and got[7]["score"] == 0.5


def test_language_held_out(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs.where(held), model, ["doc_id", "lang"]).where("lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0


def test_language_odd(odd_docs, no_docs):
    empty = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, empty, ["doc_id"]).collect()} == {"und"}
    model = langid.fit(odd_docs)
    assert langid.identify(odd_docs, model, ["doc_id"]).count() == odd_docs.count()
    assert langid.identify(no_docs, model, ["doc_id"]).count() == 0


# 3 packing


def test_packing_is_whole(spark, docs, odd_docs, library):
    for table in (docs.select("doc_id", "text"), odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        got = packing.pack(packing.pieces(table, VOCABULARY, ["doc_id"], capacity=300), capacity=300)
        rows = got.collect()
        expected = {}
        for r in table.collect():
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            for k in range(0, len(ids), 300):
                expected[r["doc_id"], k // 300] = (k, len(ids[k : k + 300]), ids[k : k + 300].tobytes())
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], bytes(r["ids"])) for r in rows} == expected
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
        for parts in by.values():
            at = 0
            for offset, length, _ in sorted(parts):
                assert offset == at
                at += length
            assert at <= 300
        whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(got).collect()}
        assert whole == {k: b"".join(x for _, _, x in sorted(v)) for k, v in by.items()}


def fewest(lengths, capacity):
    """Fewest bins by trying everything."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest():
    rng = np.random.default_rng(3)
    better = 0
    for _ in range(60):
        lengths = sorted(map(int, rng.integers(8, 60, 9)), reverse=True)
        stock = dict(Counter(lengths))
        got = packing.complete(stock, 100)
        used = Counter()
        for uses, times in got:
            assert sum(k * n for k, n in uses.items()) <= 100
            for k, n in uses.items():
                used[k] += n * times
        assert used == Counter(stock)
        n, first = sum(t for _, t in got), sum(t for _, t in packing.best_fit(stock, 100))
        assert packing.lower_bound(stock, 100) <= fewest(lengths, 100) <= n <= first
        assert n == fewest(lengths, 100)
        better += n < first
    assert better


def test_search_ends_its_first_dive_on_many_lengths():
    lengths = np.clip(np.random.default_rng(0).lognormal(np.log(570), 1.1, 20_000).astype(int) + 1, 1, 4096)
    stock = Counter(lengths.tolist())
    got = packing.complete(dict(stock), 4096)
    used = Counter()
    for uses, times in got:
        assert sum(k * n for k, n in uses.items()) <= 4096
        used.update({k: n * times for k, n in uses.items()})
    assert used == stock and len(stock) > 3000
    bound = packing.lower_bound(dict(stock), 4096)
    assert sum(n for _, n in got) == bound < sum(n for _, n in packing.best_fit(dict(stock), 4096))


def test_search_names_its_limits_above_48_lengths():
    stock = {k: 1 + k % 3 for k in range(20, 90)}
    array = np.array([stock.get(k, 0) for k in range(101)])
    assert 1 <= len(packing.fillings(array, 100)) <= packing.WIDTH and "``WIDTH``" in packing.__doc__ and "// 24" in packing.__doc__
    got, used = packing.complete(stock, 100, 50), Counter()
    for uses, times in got:
        used.update({k: n * times for k, n in uses.items()})
    assert used == Counter(stock)
    assert packing.lower_bound(stock, 100) <= sum(n for _, n in got) <= sum(n for _, n in packing.best_fit(stock, 100))


def test_packing_empty(no_docs):
    assert packing.pack(packing.pieces(no_docs, VOCABULARY, ["doc_id"])).count() == 0


# 5 decontamination


def test_decontamination_brute_force(spark, odd_docs, no_docs):
    long = odd_docs.where("doc_id = 5").first()["text"]
    words = long.split()
    items = [(1, long), (10, " ".join(words[3:13]).upper() + "!"), (2, " ".join(words[20:24])), (3, None), (4, "..."), (5, "a"), (5, "zzz qqq"), (6, " ".join(words[3:13]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    for size in (1, 40, 10_000):  # items searched in many blocks, or in one
        got = decontaminate.contamination(odd_docs, benchmark, block_windows=size).collect()
        assert len(got) == odd_docs.count()
        texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
        for r in got:
            w, hit, found = plain_words(texts[r["doc_id"]]), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), names, bool(hit))
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert not decontaminate.contamination(odd_docs, benchmark.limit(0)).where("contaminated or n_hit > 0").count()


# 6 n-gram scores


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 5), (1, 1), (7, 8), (1000, 1 << 12), (1000, 1 << 40), (5000, 1 << 20)):
        values = np.sort(rng.choice(universe, n, replace=False) if universe < 1 << 21 else np.unique(rng.integers(0, universe, n))).astype(np.uint64)
        seq = eliasfano.Sequence(eliasfano.encode(values, universe))
        assert (seq.get(np.arange(len(values))) == values).all()
        if len(values):
            assert (seq.find(values) == np.arange(len(values))).all()
            others = rng.integers(0, universe, 500).astype(np.uint64)
            at = {int(v): i for i, v in enumerate(values)}
            assert [at.get(int(v), -1) for v in others] == seq.find(others).tolist()


def test_ngram_scores_brute_force(docs, odd_docs):
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).select("doc_id", "text")
    table = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text").where("doc_id < 13").withColumn("doc_id", F.col("doc_id") + 100_000))
    got = {r["doc_id"]: r for r in ngram.train_and_score(table, train, ["doc_id"], shards=4).collect()}
    count = [Counter() for _ in range(4)]
    for r in train.collect():
        w = [*white_words(r["text"]), None]
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                count[n][tuple(w[k : k + n])] += 1
    total, kinds = sum(count[1].values()), len(count[1])
    left = {}
    for n in (2, 3):
        for g, k in count[n].items():
            if k >= 2:
                left[g[:-1]] = left.get(g[:-1], 1) - (k - ngram.DISCOUNT) / count[n - 1][g[:-1]]

    def chance(g):
        if len(g) == 1:
            return (count[1][g] + 0.5) / (total + 0.5 * (kinds + 1))
        if count[len(g) - 1][g[:-1]] < (2 if len(g) == 3 else 1):
            return chance(g[1:])
        k = count[len(g)][g]
        return ((k - ngram.DISCOUNT) / count[len(g) - 1][g[:-1]] if k >= 2 else 0) + left.get(g[:-1], 1.0) * chance(g[1:])

    for r in table.collect():
        w = [*white_words(r["text"]), None]
        q = got[r["doc_id"]]
        assert (q["n_tokens"], q["n_known"], q["train_tokens"]) == (len(w), sum(count[1][(x,)] > 0 for x in w), total)
        assert math.isclose(q["base_score"], sum(math.log10(chance((x,))) for x in w), rel_tol=1e-9)
        exact = sum(math.log10(chance(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert abs(q["score"] - exact) <= 0.02 * len(w)  # one byte for each probability


def test_ngram_hot_contexts_are_parted(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"the w{w}" if k % 2 else f"the the w{w} x" for k, w in enumerate(rng.integers(0, 300, 60))) for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in ngram.train_and_score(table, table, ["doc_id"], shards=4).collect()}
    monkeypatch.setattr(ngram, "PART_TOKENS", 700)
    monkeypatch.setattr(ngram, "RANGE", 100)
    layout = ngram.train(table, folder=str(tmp_path / "model"), shards=4)
    got = {r["doc_id"]: r["score"] for r in ngram.score(table, layout, ["doc_id"]).collect()}
    assert all(abs(got[i] - whole[i]) <= 0.01 * len(texts[i].split()) for i in whole)
    for level in layout.entries:  # all followers of the hot word, in files of bounded size
        assert max(len(x) for x in level) > 2 and max(n for x in level for _, n in x) < 300
        hot = [[start // sum(layout.words) for start, _ in x] for x in level]
        assert level is not layout.entries[0] or any(len(set(x)) < len(x) for x in hot)


def test_ngram_without_training(odd_docs, no_docs):
    got = ngram.train_and_score(odd_docs, no_docs, ["doc_id"]).collect()
    assert len(got) == odd_docs.count() and all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in got)
    assert ngram.train_and_score(no_docs, odd_docs, ["doc_id"]).count() == 0


# 7 quality


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.fit(docs.where(~held), labels)
    got = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(held).collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got) > 0
    assert all((r["score"] >= quality.THRESHOLD) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got)


def test_quality_threshold_is_a_quantile():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > -0.8).astype(float)
    model = quality.fit_arrays(x, y)
    assert abs((model.score(x) < quality.THRESHOLD).mean() - (y == 0).mean()) < 0.02
    assert ((model.score(x) >= quality.THRESHOLD) == (y == 1)).mean() > 0.9


def test_quality_pairs_are_never_held_all_at_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 49))
    y = (x[:, 0] + rng.normal(size=5000) > 0).astype(float)
    tracemalloc.start()
    model = quality.fit_arrays(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * x.nbytes  # the differences of all pairs alone would be 12 times the rows
    assert model.weights[0] > 3 * np.abs(model.weights[1:]).max()


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    for few in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.score(odd_docs, quality.fit(odd_docs, few), ["doc_id"]).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(no_docs, quality.fit(no_docs, labels), ["doc_id"]).count() == 0


# 8 near-duplicates


def components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def shingles(text):
    w = white_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_brute_force(docs, percent):
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    expected = components(sets, percent)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_chain_of_copies(spark, monkeypatch):
    """Copies that drift word by word: the ends are far apart, links hold only between neighbours."""
    monkeypatch.setattr(minhash, "CHUNK", 8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        words[3 * k : 3 * k + 1] = [f"x{k}"]
        rows.append((k, " ".join(words)))
    rows += [(100 + k, rows[7][1]) for k in range(30)]
    sets = {i: shingles(t) for i, t in rows}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(sets, 85)


def test_minhash_odd(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["component_id"] for i in (5, 6, 7, None) for r in by[i]] == [5] * 5
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (0, 1, 2))
    assert not by[None][0]["kept"]
    assert minhash.near_duplicates(no_docs).count() == 0


# 9 token counts


def test_token_counts(docs, odd_docs, no_docs, library):
    for table in (docs, odd_docs):
        texts = [(r["doc_id"], r["text"]) for r in table.collect()]
        expected = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
        got = tokencount.count_tokens(table, VOCABULARY, limit=100).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert tokencount.count_tokens(no_docs, VOCABULARY).count() == 0


def test_every_prefix(odd_docs, library):
    short = odd_docs.where("doc_id not in (13, 14)").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in short.collect()}
    for r in tokencount.prefix_table(short, VOCABULARY).collect():
        t = texts[r["doc_id"]]
        assert r["counts"] == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
    dp = tokencount.counter(VOCABULARY)
    t = texts[5]
    n = dp.cut(t, 10)
    assert dp.at(t, n) <= 10 < dp.at(t, n + 1)


# 10 sharding


def test_sharding_laws(docs, odd_docs, no_docs):
    tree = sharding.two_regions(8)
    for table in (docs, odd_docs):
        got = sharding.shard_documents(table, tree, sharding.grown(tree, "8")).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8 and r["law"] == "key"
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.shard_documents(no_docs, tree, tree).count() == 0


def test_sharding_confines_movement(spark):
    ids = spark.range(8000)
    tree = {"a": {"r": {"1": 1.0, "2": 2.0}, "s": {"3": 1.0}}, "b": {"t": {"4": 4.0}}}
    heavier = {"a": {"r": {"1": 1.0, "2": 4.0}, "s": {"3": 1.0}}, "b": {"t": {"4": 4.0}}}
    rows = ids.select(sharding.descend(F.col("id"), tree).alias("x"), sharding.descend(F.col("id"), heavier).alias("y")).collect()
    share = Counter(r["x"] for r in rows)
    assert all(abs(share[k] / 8000 - w / 8) < 0.02 for k, w in (("1", 1), ("2", 2), ("3", 1), ("4", 4)))
    moved = Counter((r["x"], r["y"]) for r in rows if r["x"] != r["y"])
    assert moved and all(y != "4" for _, y in moved)  # nothing moves into the region whose weight stayed


def test_near_copies_of_a_repeated_id(spark):
    """An id with two texts links with the near copies of either; equal sets of one id count once."""
    rng = random.Random(21)
    one, two, other = sentence(rng, 60), sentence(rng, 60), sentence(rng, 60)
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (3, two + " y"), (4, other), (5, None), (1, None), (None, two), (6, other + " z z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table).collect()), key=repr)
    size = lambda t: len({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)})
    first = {1: 1, 2: 1, 3: 1, None: 1, 4: 4, 6: 4, 5: 5}
    assert got == sorted(((i, size(t or ""), first[i], i == first[i]) for i, t in rows), key=repr)
