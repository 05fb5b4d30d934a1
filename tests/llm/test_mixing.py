"""Source mixing against a plain version, and its defined cases."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from queryscope.llm import mixing
from tests.llm.conftest import sentence

OUT = ["doc_id", "size", "source_size", "target", "taken", "whole"]


def brute_mix(rows, weights=(1, 2, 3), epochs=3, seed=0):
    """rows: (doc_id, source, text)."""
    docs = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, s, t in rows]
    own = defaultdict(list)
    for i, s, n in docs:
        own[s].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n, i))
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = {s: sum(x[3] for x in own[s]) for s in names}
    target, open_, left = {}, set(names), sum(size.values())
    while open_:
        level = Fraction(left, sum(weight[s] for s in open_))
        full = {s for s in open_ if level * weight[s] > epochs * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: Fraction(epochs * size[s]) for s in full}
        left -= sum(epochs * size[s] for s in full)
        open_ -= full
    out = []
    for s in names:
        whole, rest = divmod(int(target[s]), size[s]) if size[s] else (0, 0)
        for _, _, _, n, i in sorted(own[s]):
            part = min(n, rest)
            rest -= part
            out.append((i, n, size[s], float(target[s]), whole * n + part, whole))
    return sorted(out, key=repr), sum(size.values())


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*OUT).collect()), key=repr)


def test_mix_brute_force(spark, rng_rows=400):
    import random

    rng = random.Random(3)
    sources = ["z", "a", "ä", "￿", "𐀀", "", None, "B"]
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(sources), sentence(rng, rng.choice([0, 1, 5, 50]))) for i in range(rng_rows)]
    rows += [(1, "hot", "one two"), (1, "hot", "one two"), (None, "hot", None), (None, None, ""), (900, "long", sentence(rng, 30_000)), (901, "empty", " \t")]
    table = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, source string, text string, size int, draw string, level double")
    expected, total = brute_mix(rows)
    got = rows_of(mixing.mix(table))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in expected]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(got, expected))
    assert rows_of(mixing.mix(table.repartition(13))) == got
    assert all(r[4] <= 3 * r[1] for r in got) and sum(r[4] for r in got) <= total
    reached = Counter()
    for r in got:
        reached[r[3]] += r[4]
    shared = Counter({r[3]: 0 for r in got})
    for t in {(r[2], r[3]) for r in got}:
        shared[t[1]] += 1
    assert all(reached[t] == int(t) for t, n in shared.items() if n == 1)  # to the word where a target belongs to one source


def test_clamping_goes_on_until_feasible(spark):
    """The first excess pushes a second source over its cap."""
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate([("a", 600), ("b", 10), ("c", 110), ("d", 300)])]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    expected, _ = brute_mix(rows, weights=(1, 2, 3, 1))
    got = rows_of(mixing.mix(table, weights=(1, 2, 3, 1)))
    assert got == expected and [r[4] for r in got if r[1] == 10] == [30] and [r[4] for r in got if r[1] == 110] == [330]


def test_nothing_to_mix(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(blank.where(F.lit(False))).count() == 0
