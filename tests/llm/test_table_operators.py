"""URL rules and vectors against brute force, and their defined cases."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from queryscope.llm import lattice, queries, url_filter

SMALL = "/root/testdata/sf0.01"


def brute_rules(rows, support, confidence):
    """Minimal token sets that come with a bad label often enough."""
    n, found = len(rows), {}
    kinds = sorted({t for tokens, _ in rows for t in tokens})
    for size in range(1, 4):
        for s in combinations(kinds, size):
            has = [bad for tokens, bad in rows if set(s) <= tokens]
            if sum(has) >= support * n - 1e-9 and has and sum(has) / len(has) >= confidence:
                found[s] = sum(has) / len(has)
    return {s for s in found if not any(set(o) < set(s) for o in found)}


def test_rules_brute_force(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'ok'}.com/{'x' if i % 2 else 'y'}/{i}?{'q' if i % 5 else 'z'}=1", i % 3 == 0 and i % 2 == 1) for i in range(120)]
    table = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = url_filter.mine_rules(table, "url", "bad", 0.05, 0.9, 1).collect()
    tokens = [(set(r["t"]), r["bad"]) for r in table.select(url_filter.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    expected = brute_rules(tokens, 0.05, 0.9)
    assert {tuple(sorted(r["tokens"])) for r in mined} == expected and expected
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(table, table, min_support=0.05, min_confidence=0.9, min_rows=1).collect()}
    assert got == {i: "block" if any(set(s) <= t for s in expected) else "allow" for (i, _, _), (t, _) in zip(rows, tokens)}


def test_long_urls_are_mined(spark):
    """Forty words that always come together, on bad pages and on mixed ones, next to a rule of two tokens."""
    long = "/".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(i, f"http://a{i % 4}.com/{long}/{'x' if i % 2 else 'y'}/{i}", i % 4 == 1) for i in range(400)]
    rows += [(400 + i, f"http://bad.net/{long.replace('word', 'w')}/{i}", True) for i in range(60)]
    rows += [(500 + i, f"http://a1.com/z/{i}", False) for i in range(200)]
    table = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r["page_id"]: (r["verdict"], r["n_rules"] > 0) for r in url_filter.judge(table, table, min_support=0.01, min_confidence=0.9, min_rows=20).collect()}
    assert got == {i: ("block", True) if b else ("allow", False) for i, _, b in rows}
    short = [r for r in rows if r[0] < 400 or r[0] >= 500]
    small = spark.createDataFrame([(i, u.replace(long, "/".join(long.split("/")[:3])), b) for i, u, b in short], "page_id long, url string, bad boolean")
    mined = url_filter.mine_rules(small, "url", "bad", 0.01, 0.9, 1).collect()
    tokens = [(set(r["t"]), r["bad"]) for r in small.select(url_filter.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    assert {tuple(sorted(r["tokens"])) for r in mined} == brute_rules(tokens, 0.01, 0.9)


def test_listed_rules_and_odd_urls(spark):
    cases = {
        "http://a.example.org/es/1?x=/en": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "HTTP://Example.ORG/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/?a": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://a://b.org/x": ("a:", "//b.org/x", None, "allow"),
        "no address": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.ORG/" + "x" * 100_000: ("É.org", "/" + "x" * 100_000, "org/", "allow"),
        "http://x.org/a\nb?c": ("x.org", "/a\nb", "org/", "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None, "v", "k") for i, u in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean, verdict string, token string")
    lists = {"allow": ["org/"], "block": ["example.org/es/", "example.org/en/1", "com/de/"]}
    got = url_filter.judge(pages, pages, **lists).collect()
    wanted = list(cases.values())
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == wanted[r["page_id"]]
    assert url_filter.judge(pages.limit(0), pages.limit(0), **lists).count() == 0


def test_pages_are_labelled_by_the_document_of_their_path(spark, tmp_path):
    ends = ("", ".html", "/", "?page=2&ref=x", "#top")
    pages = [(k, f"https://{'bad' if k < 60 else 'good'}.example.com/en/{1000 + k}{ends[k % 5]}") for k in range(300)]
    pages += [(300, None), (301, "http://bad.example.com/en/"), (302, "http://bad.example.com/en/" + "9" * 40), (303, "no address 1001"), (304, "http://x.com/?a=/1001")]
    labels = [(1000 + k, int(k >= 60)) for k in range(300)] + [(k, 1) for k in range(305)] + [(None, 0)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: (r["verdict"], r["n_rules"]) for r in queries.QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {k: ("block", 1) if u and "//bad." in u else ("allow", 0) for k, u in pages}
    names = spark.createDataFrame(pages, "page_id long, url string").select("page_id", url_filter.document_of(F.col("url")).alias("d")).collect()
    assert {r["page_id"]: r["d"] for r in names} == {k: 1000 + k if k < 300 else None for k, _ in pages}


def brute_links(rows, threshold):
    links, root = Counter(), {r["vec_id"]: r["vec_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a)

    own = [(r["vec_id"], r["label"], u) for r in rows if r["label"] is not None and (u := unit(r["embedding"])) is not None]
    for (a, la, x), (b, lb, y) in combinations(own, 2):
        if la == lb and len(x) == len(y) and x @ y >= threshold:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return links, {i: find(i) for i in root}


def test_lattice_decoder_is_nearest():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(50, 8)) * 2
    near = lattice.decode(y)
    assert (((2 * near) % 1) == 0).all() and ((near.sum(1) % 2) == 0).all()
    gap = ((y - near) ** 2).sum(1)
    for v in lattice.SHORTEST:
        assert (((y - near - v) ** 2).sum(1) >= gap - 1e-9).all()


def test_vectors_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 16)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 3))
        if i >= 100 and rng.random() < 0.6:  # near copies of earlier vectors, around the threshold, in one large group too
            _, v, label = rows[0 if rng.random() < 0.5 else int(rng.integers(0, 100))]
            v = np.array(v) + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.05, 0.06])
        else:
            v = rng.normal(size=16)
        rows.append((i, [float(x) for x in v], label))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] * 16, 1)]
    rows += [(1006, rows[0][1], None), (1007, rows[0][1][:8], rows[0][2]), (1008, [x * 1e30 for x in rows[0][1]], rows[0][2])]
    table = spark.createDataFrame([(*r, 1, "k", True) for r in rows], "vec_id long, embedding array<double>, label int, row int, key string, home boolean")
    links, comps = brute_links(table.collect(), 0.98)
    got = lattice.near_vectors(table).collect()
    assert len(got) == len(rows) and max(links.values()) > 32
    found = sum(r["n_links"] for r in got)
    assert found >= 0.99 * sum(links.values()) and all(r["n_links"] <= links[r["vec_id"]] for r in got)
    assert sum(r["component_id"] == comps[r["vec_id"]] for r in got) >= 0.99 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.near_vectors(table.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    """Half of all vectors are one; copies count as links, ids may repeat."""
    rng = np.random.default_rng(3)
    base = [float(x) for x in rng.normal(size=16)]
    near = [float(x) for x in np.array(base) + rng.normal(size=16) * 0.02]
    rows = [(i, base, 1) for i in range(2000)] + [(i, near, 1) for i in range(2000, 2100)] + [(i, base, 2) for i in range(3000, 3010)]
    rows += [(4000 + i, [float(x) for x in rng.normal(size=16)], 1) for i in range(200)] + [(5, base, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(table).collect()}
    assert all(got[i] == (2100, 0, i == 0) for i in range(2100)) and all(got[i] == (9, 3000, i == 3000) for i in range(3000, 3010))
    assert all(got[4000 + i] == (0, 4000 + i, True) for i in range(200))


def test_vectors_recall_on_the_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    for threshold in (0.98, 0.35):  # no two vectors are as near as the first; the second is far below what the tables aim at
        links, _ = brute_links(table.collect(), threshold)
        got = lattice.near_vectors(table, threshold=threshold).collect()
        if threshold == 0.98:
            assert {r["vec_id"]: r["n_links"] for r in got if r["n_links"]} == dict(links)
        else:
            assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
