"""Near-duplicate documents by MinHash banding, exact verification and connected components.

1. Every text gets the set of its 5-word shingles (hashed), the minima of ``bands * rows`` universal hashes of that set and
   a 128-bit fingerprint of the set. Equal sets are collapsed to one representative before anything is compared.
2. Representatives whose minima agree in all rows of a band share a bucket. Each is paired with the bucket's least member
   (a star, so pairs grow with the members and not with their square); pairs pass the signature test and are then
   confirmed on the full sets.
3. Components of confirmed pairs come from alternating large-star and small-star. Buckets that still hold members of
   several components are looked at again: their members are cut into chunks of ``CHUNK``, and pairs of chunks are
   compared inside a task, first by signature, then on the full sets of the members that are left. A pair is looked at in
   the first band that it shares only, and not once its components are joined. A task sends on the links that join
   components, fewer than its members, so no link between components is lost and no pairs are listed, however large a
   bucket is.

A link at the threshold is missed by all bands with a chance of (1 - t**rows)**bands: 4e-7 at 0.85, 5e-5 at 0.8 (25 bands
of 5 rows).

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are kept; fewer words than a
shingle form one shingle; copies form one component; rows of a repeated id belong together, whatever their texts, and
link with what any of them links with; a row without id joins the group of its set but leads none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import forget, kept, lean, stored, texts_of, type_of
from queryscope.llm.components import connected
from queryscope.llm.wordhash import WHITE, Words, chained, mix, runs_inside, slices
from queryscope.session import cut

SHINGLE, BANDS, ROWS = 5, 25, 5
#: members of a bucket compared in one task with those of another chunk
CHUNK = 512
#: tasks over which the rows of one set are dealt
SALTS = 16


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the shingles of each text in order, with repeats; shorter texts are one shingle."""
    at, bounds = runs_inside(words.first, size)
    every = chained(words.hashes, size)
    counts = np.diff(words.first)
    if not ((counts > 0) & (counts < size)).any():
        return every[at] if len(at) else np.empty(0, np.uint64), bounds
    parts, own = [], []
    for k, n in enumerate(counts):
        if n >= size:
            parts.append(every[words.first[k] : words.first[k + 1] - size + 1])
        elif n:
            parts.append(chained(words.hashes[words.first[k] : words.first[k + 1]], int(n)) ^ np.uint64(n))
        own.append(len(parts[-1]) if n else 0)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(own)])


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    parts = [np.unique(h) for h in _parts(hashes, bounds)]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) minima of ``n`` multiply-add hashes, folded to 16 bits: different minima agree with a chance of 2^-16, equal ones
    always; texts must not be empty."""
    a, b = _coefficients(n)
    out = np.empty((len(bounds) - 1, n), np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < len(bounds) - 1:  # runs of texts that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 30_000, "right")) - 1)
        x, at = low[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        v = np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=v)
            v += b[k]
            out[lo:hi, k] = np.minimum.reduceat(v, at)
        lo = hi
    return (out ^ (out >> np.uint32(16))).astype(np.uint16)


def _fingerprints(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and xor of the mixed hashes of the sets that start at ``at``."""
    s = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
    return s, np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x14057B7EF767814F)), at)


def _is_set(hashes: np.ndarray, n: int, x: int) -> bool:
    """Is this the set with that size and fingerprint? A repeated id brings the texts of its other rows, too."""
    return len(hashes) == n and int(_fingerprints(hashes, np.zeros(1, np.int64))[1].view(np.int64)[0]) == x


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(node, n, s, x, sig) per row: set size, fingerprint of the set (sum and xor of mixed hashes), minima; null sig if empty."""
    own = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node")
            for i, j, w in slices(b.column("t"), WHITE):
                hashes, bounds = _distinct(*shingles(w, size))
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                s = np.zeros(j - i, np.uint64)
                x = np.zeros(j - i, np.uint64)
                sig = [None] * (j - i)
                if len(full):
                    at = bounds[:-1][full]
                    s[full], x[full] = _fingerprints(hashes, at)
                    for k, v in zip(full, signatures(hashes, np.append(at, len(hashes)), bands * rows)):
                        sig[k] = v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [node.slice(i, j - i), pa.array(n, pa.int64()), pa.array(s.view(np.int64)), pa.array(x.view(np.int64)), pa.array(sig, pa.binary())],
                    names=["node", "n", "s", "x", "sig"],
                )

    return own.mapInArrow(lean(run), "node bigint, n bigint, s bigint, x bigint, sig binary")


def band_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, band, node) for every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, bands * rows).astype(np.uint64)
            node = b.column("node").to_numpy()
            keys = np.empty((len(node), bands), np.uint64)
            for k in range(bands):
                h = np.full(len(node), k + 1, np.uint64)
                for r in range(rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * rows + r])
                keys[:, k] = h
            band = np.tile(np.arange(bands, dtype=np.int32), len(node))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(node, bands))], names=["key", "band", "node"]
            )

    return reps.select("node", "sig").mapInArrow(lean(run), "key bigint, band int, node bigint")


def packed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, t): texts compressed one by one, since all of them are shuffled and few are read again."""
    own = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            raw = [t.encode() for t in texts_of(b, "t")]
            packed = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) if x else b"" for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(packed, pa.binary())], names=["node", "t"])

    return own.mapInArrow(lean(run), "node bigint, t binary")


def unpacked(column: pa.Array) -> pa.Array:
    """Texts of ``packed_texts``."""
    codec = pa.Codec("zstd", 1)
    raw = [codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True) if z else b"" for z in column.to_pylist()]
    return pa.array(raw, pa.large_binary()).cast(pa.large_string())


def confirm(pairs: DataFrame, heads: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of their full shingle sets; ``texts`` from ``packed_texts``.

    Texts are shuffled once; both joins read the same exchange. ``heads``: node, n, x and the document (rep) that has the set.
    """
    named = lambda k: heads.select(F.col("node").alias(k), *[F.col(c).alias(c + k) for c in ("rep", "n", "x")])
    a = texts.select(F.col("node").alias("repu"), F.col("t").alias("tu"))
    b = texts.select(F.col("node").alias("repv"), F.col("t").alias("tv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch, k: str) -> Iterator[np.ndarray | None]:
            known = zip(batch.column("n" + k).to_pylist(), batch.column("x" + k).to_pylist())
            for _, _, w in slices(unpacked(batch.column("t" + k)), WHITE):
                h, at = shingles(w, size)
                for (lo, hi), (n, x) in zip(zip(at[:-1], at[1:]), known):
                    own = np.unique(h[lo:hi])
                    yield own if _is_set(own, n, x) else None

        for batch in batches:
            ok = []
            for x, y in zip(sets(batch, "u"), sets(batch, "v")):
                both = 0 if x is None or y is None else len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(named("u"), "u").join(named("v"), "v").join(a, "repu").join(b, "repv")
    return met.select("u", "v", "nu", "xu", "tu", "nv", "xv", "tv").mapInArrow(lean(run), "u bigint, v bigint")


def _near(percent: int, n: int) -> int:
    """Agreeing minima below which a pair at the threshold is left out: five deviations under the mean."""
    p = percent / 100
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def signature_test(pairs: DataFrame, reps: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs whose sizes and minima allow the similarity; ``reps``: node, n, sig."""
    a = reps.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    b = reps.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    least = _near(percent, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, n) for c in ("su", "sv"))
            ok = (x == y).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok))

    joined = pairs.join(a, "u").join(b, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return joined.select("u", "v", "su", "sv").mapInArrow(lean(run), "u bigint, v bigint")


def _candidates(t: pa.Table, sig: np.ndarray, percent: int, bands: int, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(member, others) of a chunk pair: different components, fitting sizes and minima, and no earlier band in common."""
    side, node, size, comp = (t.column(c).to_numpy() for c in ("side", "node", "n", "comp"))
    p, q, band = (t.column(c)[0].as_py() for c in ("p", "q", "band"))
    least, right = _near(percent, bands * rows), np.flatnonzero(side == q)
    for i in np.flatnonzero(side == p):
        fit = right[(comp[right] != comp[i]) & ((node[right] > node[i]) if p == q else (node[right] != node[i]))]
        fit = fit[np.minimum(size[fit], size[i]) * 100 >= np.maximum(size[fit], size[i]) * percent]
        if len(fit):
            same = sig[fit] == sig[i]
            first = same.reshape(-1, bands, rows).all(2).argmax(1)
            fit = fit[(same.sum(1) >= least) & (first == band)]
        if len(fit):
            yield int(i), fit


def _across(members: DataFrame, texts: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Links (u, v) that join different components inside a bucket; ``members``: key, band, node, rep, n, x, sig, comp."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("_size"))
    cut_up = members.join(sizes, "key").withColumn("_c", F.ceil(F.col("_size") / CHUNK).cast("int"))
    cut_up = cut_up.withColumn("side", F.pmod(F.xxhash64("node"), F.col("_c")).cast("int"))
    spread = cut_up.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    spread = spread.select("key", F.least("side", "_j").alias("p"), F.greatest("side", "_j").alias("q"), "band", "side", "node", "rep", "n", "x", "sig", "comp")

    def left(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, bands * rows)
        some: set[int] = set()
        for i, fit in _candidates(t, sig, percent, bands, rows):
            some.add(i)
            some.update(fit.tolist())
        return t.drop_columns(["sig"]).take(pa.array(sorted(some), pa.int64()))

    def joined(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        sets: list[np.ndarray] = []
        for _, _, w in slices(unpacked(t.column("t")), WHITE):
            sets += [np.unique(h) for h in _parts(*shingles(w, size))]
        own = [k for k, (h, n, x) in enumerate(zip(sets, t.column("n").to_pylist(), t.column("x").to_pylist())) if _is_set(h, n, x)]
        node_of = t.column("node").to_pylist()
        own = list({node_of[k]: k for k in own}.values())  # equal rows of one id bring the same text
        t, sets = t.take(pa.array(own, pa.int64())), [sets[k] for k in own]
        if not sets:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        sizes = np.cumsum([0, *map(len, sets)])
        sig = signatures(np.concatenate(sets), sizes, bands * rows)  # cheaper to make again than to send
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        us, vs = [], []
        for i, fit in _candidates(t, sig, percent, bands, rows):
            x = sets[i]
            for j in fit.tolist():
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b:
                    both = len(np.intersect1d(x, sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                        root[max(a, b)] = min(a, b)
                        us.append(node[i])
                        vs.append(node[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    own = "key bigint, p int, q int, band int, side int, node bigint, rep bigint, n bigint, x bigint, comp bigint"
    few = cut(spread.groupBy("key", "p", "q").applyInArrow(left, own))
    given = texts.select(F.col("node").alias("rep"), "t")
    return few.join(given, "rep").drop("rep").groupBy("key", "p", "q").applyInArrow(joined, "u bigint, v bigint")


def _parts(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _same_ids(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges (u, v) between the sets that one id has in different rows."""
    own = rows.where("node IS NOT NULL AND n > 0").select("node", "n", "s", "x")
    differ = " OR ".join(f"min({c}) < max({c})" for c in ("n", "s", "x"))
    several = own.groupBy("node").agg(F.expr(differ).alias("d")).where("d").select("node")
    sets = own.join(several, "node").distinct().join(heads.select("n", "s", "x", F.col("node").alias("u")), ["n", "s", "x"])
    least = sets.groupBy("node").agg(F.min("u").alias("v"))
    return sets.join(least, "node").where("u <> v").select("u", "v")


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(node, n_shingles, component) per row of ``docs``.

    A node of the graph is a distinct set (n, s, x); the least id that has it (rep) lends its text.
    """
    n = bands * rows
    spark = docs.sparkSession
    sketched, sketch_path = kept(sketch(docs, id_col, text_col, size, bands, rows))
    # equal sets have equal minima, so these may stand in the key
    heads = sketched.where("n > 0").groupBy("n", "s", "x", "sig").agg(F.min("node").alias("rep"))
    heads = stored(heads.withColumn("node", F.monotonically_increasing_id()))
    members = stored(sketched.select("node", "n", "s", "x"))
    forget(spark, sketch_path)
    reps = heads.where("rep IS NOT NULL").select("node", "rep", "n", "x", "sig")
    same = _same_ids(members, heads)

    buckets = band_keys(reps, bands, rows)
    least = buckets.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "v")
    shared = stored(buckets.join(least, "key").select("key", "band", "node", "v"))
    texts = packed_texts(docs, id_col, text_col)
    stars = shared.where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    stars = stored(signature_test(stars, reps, percent, n))
    links = stored(confirm(stars, reps, texts, size, percent).unionByName(same).distinct())
    first = connected(links)

    labelled = shared.select("key", "band", "node").join(first, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    rest = labelled.join(mixed, "key", "left_semi").join(reps, "node")
    found = stored(_across(rest, texts, size, percent, bands, rows).distinct())
    final = connected(links.unionByName(found)) if not found.isEmpty() else first

    # the least id of each component, for every set that has it, then for the rows of each set
    sets = heads.select("node", "n", "s", "x", "rep").join(final.withColumnRenamed("component", "c"), "node", "left")
    sets = sets.withColumn("c", F.coalesce("c", "node"))
    named = sets.groupBy("c").agg(F.min("rep").alias("component"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("k")
    sets = sets.join(named, "c").select("n", "s", "x", "component", salt)
    full = members.where("n > 0").withColumn("k", F.coalesce(F.pmod(F.xxhash64("node", F.monotonically_increasing_id()), F.lit(SALTS)), F.lit(0)).cast("int"))
    placed = full.join(sets, ["n", "s", "x", "k"]).select("node", "n", "component")
    # a row without words belongs where another row of its id does
    other = placed.where("node IS NOT NULL").groupBy(F.col("node").alias("i")).agg(F.min("component").alias("component"))
    empty = members.where("n = 0").select("node", "n")
    empty = empty.join(other, F.col("node") == F.col("i"), "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    return placed.unionByName(empty).select("node", F.col("n").alias("n_shingles"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, **options) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable by links), kept (id = component_id)."""
    out = components(docs, id_col, text_col, percent, **options)
    return out.select(
        F.col("node").cast(type_of(docs, id_col)).alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("node").eqNullSafe(F.col("component")).alias("kept")
    )
