"""Near-duplicate embeddings by lattice hashing.

In each of ``TABLES`` tables a vector is projected at random to ``BLOCKS`` times 8 dimensions, and every 8 dimensions are
decoded to the nearest point of the E8 lattice. The points name the vector's home cell. It also probes the ``PROBES``
neighbouring cells (one block moved by a shortest lattice vector) that its projection is nearest to. Two vectors meet in
a cell if it is the home of one, and the home or a probe of the other; pairs that meet are compared by cosine in double
precision.

Work is dealt by (table, label, cell). Cells that cannot hold a pair are dropped on narrow rows before any vector is
shuffled. Members of a cell are cut into chunks of ``CHUNK`` and pairs of chunks are compared inside a task, so a cell of
any size spreads over many tasks. A task emits no pairs: for each vector the number of links that are counted here (a pair
counts only in the first cell in which it meets, which both vectors' cells tell) and a local root that it is linked to.

At cosine 0.98 two random directions meet in a table with a chance of about 0.79, in one of 6 tables with over 0.999.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, link
with nothing; vectors of different lengths never link; equal vectors link; repeated ids count as other vectors of the
same id, a vector without id is counted but joins no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import type_of
from queryscope.llm.components import connected
from queryscope.llm.wordhash import mix
from queryscope.session import cut

TABLES, BLOCKS, PROBES, SCALE = 6, 2, 3, 2.0
#: members of a cell that one task compares with those of another chunk
CHUNK = 128


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: +-1 at two places, or +-1/2 everywhere with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, halves[(halves < 0).sum(1) % 2 == 0]])


SHORTEST = _shortest()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and move the worst coordinate if the sum is odd."""
    r = np.rint(y)
    off = y - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the even integer points and those moved by a half."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


def _projection(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([31, table, dim])
    return rng.standard_normal((dim, 8 * BLOCKS)) / SCALE, rng.random(8 * BLOCKS) * 2


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """(vectors, 1 + PROBES) cell numbers of unit vectors in one table, home first."""
    matrix, shift = _projection(table, unit.shape[1])
    y = unit @ matrix + shift
    home = np.concatenate([decode(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
    gain = np.concatenate([(y - home)[:, 8 * b : 8 * b + 8] @ SHORTEST.T for b in range(BLOCKS)], axis=1)
    best = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
    rows = np.arange(len(unit))
    points = [home]
    for k in range(PROBES):
        block, step = best[:, k] // len(SHORTEST), SHORTEST[best[:, k] % len(SHORTEST)]
        near = home.copy()
        for d in range(8):
            near[rows, 8 * block + d] += step[:, d]
        points.append(near)
    out = np.empty((len(unit), 1 + PROBES), np.uint64)
    for k, p in enumerate(points):
        h = np.full(len(unit), table + 1, np.uint64)
        twice = (2 * p).astype(np.int64).view(np.uint64)
        for d in range(p.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + twice[:, d])
        out[:, k] = h
    return out


def _units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) by length of the vectors."""
    sizes = np.array([len(v) for v in column])
    out = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
        x = x / np.abs(x).max(1, keepdims=True)
        out.append((at, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def _keys(valid: DataFrame, label: str) -> DataFrame:
    """(key, home, row): the cells of every vector; the key also holds the label and the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, labels = b.column("row").to_numpy(), b.column("tag").to_numpy().view(np.uint64)
            for at, unit in _units(b.column("v")):
                for t in range(TABLES):
                    c = cells(unit, t)
                    key = mix((c ^ labels[at][:, None]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1]))
                    home = np.zeros(c.shape, bool)
                    home[:, 0] = True
                    n = c.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.full(key.size, t, np.int32)), pa.array(home.ravel()), pa.array(np.repeat(rows[at], n))],
                        names=["key", "t", "home", "row"],
                    )

    tagged = valid.select("row", F.xxhash64(label).alias("tag"), "v")
    return tagged.mapInArrow(run, "key bigint, t int, home boolean, row bigint")


def _met_before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two vectors (rows of cells, home first) share a cell of one table."""
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


def _links(pairs: DataFrame, threshold: float) -> DataFrame:
    """(row, links, root) from chunk pairs of cells: key, p, q, t, side, home, row, v, w (vectors that the row stands for)."""

    def run(table: pa.Table) -> pa.Table:
        b = table.combine_chunks()
        t = b.column("t")[0].as_py()
        p, q = b.column("p")[0].as_py(), b.column("q")[0].as_py()
        side, home, row, w = (b.column(c).to_numpy() for c in ("side", "home", "row", "w"))
        [(_, x)] = _units(b.column("v").combine_chunks())
        every = np.triu(np.ones((len(row), len(row)), bool), 1) if p == q else (side[:, None] == p) & (side[None, :] == q)
        i, j = np.nonzero(every & (x @ x.T >= threshold) & (home[:, None] | home[None, :]))
        local = np.arange(len(row))
        count = np.zeros(len(row), np.int64)
        if len(i):
            while True:  # roots of the links seen here: the least place reachable
                least = np.minimum(local[i], local[j])
                new = local.copy()
                np.minimum.at(new, i, least)
                np.minimum.at(new, j, least)
                new = new[new]
                if (new == local).all():
                    break
                local = new
            own = cells(x, t)
            # in this table the pair counts in the lesser of the homes that both reach
            at_i = (own[i][:, :1] == own[j]).any(1)
            at_j = (own[j][:, :1] == own[i]).any(1)
            a, c = own[i, 0], own[j, 0]
            first = np.where(at_i & at_j, np.minimum(a, c), np.where(at_i, a, c))
            here = np.full(len(i), _cell_here(own, home), np.uint64)
            keep = first == here
            i, j = i[keep], j[keep]
            for earlier in range(t):
                if not len(i):
                    break
                before = cells(x, earlier)
                fresh = ~_met_before(before[i], before[j])
                i, j = i[fresh], j[fresh]
            np.add.at(count, i, w[j])
            np.add.at(count, j, w[i])
        some = np.flatnonzero((count > 0) | (local != np.arange(len(row))))
        return pa.table({"row": row[some], "links": count[some], "root": row[local[some]]})

    return pairs.groupBy("key", "p", "q").applyInArrow(run, "row bigint, links bigint, root bigint")


def _cell_here(own: np.ndarray, home: np.ndarray) -> np.uint64:
    """The cell that a group is about: the home of any member that has its home there."""
    return own[np.flatnonzero(home)[0], 0]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """Per row: id, n_links, component_id (least id reachable by links), kept (id = component_id)."""
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = cut(own.withColumn("row", F.monotonically_increasing_id()))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    # equal vectors of a label are compared as one; each links with the others of its class and with all of the linked classes
    mark = [F.xxhash64(F.lit(k), "label", "v").alias(f"h{k}") for k in (1, 2)]
    marked = valid.select("row", "id", "label", "v", *mark)
    heads = marked.groupBy("h1", "h2", "label", "v").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("w"))
    heads = cut(heads.withColumn("row", F.monotonically_increasing_id()))
    keys = cut(_keys(heads, "label"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("key", "n")
    members = keys.join(sizes, "key").withColumn("c", F.ceil(F.col("n") / CHUNK).cast("int"))
    members = members.withColumn("side", F.pmod(F.xxhash64("row"), F.col("c")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    members = members.select("key", "t", "home", "row", F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), "side")
    found = cut(_links(members.join(heads.select("row", "v", "w"), "row"), threshold))
    ids = heads.select("row", F.col("head").alias("id"))
    links = found.groupBy("row").agg(F.sum("links").alias("_l"))
    classes = heads.join(links, "row", "left").select("h1", "h2", "head", (F.coalesce("_l", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    placed = cut(marked.select("row", "id", "h1", "h2").join(classes, ["h1", "h2"]).select("row", "id", "head", "n_links"))
    edges = found.where("row <> root").select("row", "root").distinct()
    named = edges.join(ids, "row").select(F.col("id").alias("u"), F.col("root").alias("row")).join(ids, "row").select("u", F.col("id").alias("v"))
    named = named.unionByName(placed.where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")))
    comps = connected(named)
    out = rows.join(placed.select("row", "n_links"), "row", "left").join(comps, rows["id"] == comps["node"], "left")
    root = F.coalesce("component", "id")
    return out.select(
        F.col("id").cast(type_of(vectors, id_col)).alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        root.alias("component_id"),
        F.col("id").eqNullSafe(root).alias("kept"),
    )
