"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

A conversation is the sequence of its turns' 16-byte digests. Distinct sequences are sorted; neighbours are joined by an edge
whose depth is their longest common prefix, in turns. Edges are taken in descending depth: each merge of two components
creates (or widens) the branching node at that depth, and what lies between a component's node and the next one above is a
chain of nodes with the same members. A component carries its node's members, least id, children, leaves and saved tokens.

Sequences are range-partitioned. A block's forest is contracted to the nodes on the paths of its first and last sequence, which
may go on in the neighbouring blocks; every other node is final and leaves. Contracted forests are merged across the
boundaries by the same union-find, in a tree of ``FAN`` forests each, so the largest task holds one block or the paths of FAN blocks.
A long conversation is cut into segments of ``SEGMENT`` turns; a segment hangs at the node that its prefix leads to, and what
lies below that node is summed beforehand by doubling over the tree of such nodes. Copies collapse before the sort. So
neither a common first turn, nor a conversation with a third of all copies, nor one with very many turns meets in one task.

Defined cases: rows without a conversation id are left out; a null role or text is the empty text; null turns come first, equal
turns are ordered by MD5 of role and text; repeated rows are turns of their own; conversations without turns are members of the
root; an empty table has no nodes, not even a root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from queryscope.llm.common import numbered_locally, stored, with_rank

#: turns in one segment of a conversation
SEGMENT = 256
#: sequences, and bytes of their digests, in one block
BLOCK_ROWS, BLOCK_BYTES = 20_000, 8 << 20
#: contracted forests merged by one task
FAN = 32
DIGEST = 16
#: ids of one node's members that are handed on as one text
PIECE = 50_000
ANCHOR = ["seg", "a1", "a2"]


# --- rebuilding and sequences -------------------------------------------------------------------------------------------


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, pos 0.., digest, length): the turns of each conversation in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("length"),
        F.monotonically_increasing_id().alias("_u"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_u")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "length")
    return with_rank(numbered_locally(rows, "conv_id", ordered=True), "conv_id", "pos", ordered=True)


def rebuilt(turns: DataFrame, head: Column, base: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, q, digest, length, size) of conversations that start with the first ``head`` turns of conversation ``base``, and (conv_id, size)."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", head.alias("head"), base.alias("base"))
    given = own.select(F.col("conv_id").alias("_b"), F.col("n").alias("_n"))
    sizes = own.join(given, own["base"] == given["_b"], "left").select(
        "conv_id", "head", "base", F.least("head", F.coalesce("_n", F.lit(0))).alias("lead"), "n"
    )
    sizes = sizes.withColumn("size", F.col("lead") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    cut_ = sizes.select(F.col("conv_id").alias("_c"), "lead", "size", "head", "base")
    tail = turns.join(cut_, turns["conv_id"] == cut_["_c"]).where("pos >= head")
    tail = tail.select("conv_id", (F.col("pos") - F.col("head") + F.col("lead")).alias("q"), "digest", "length", "size")
    first = turns.where(F.col("pos") < longest_head).select(F.col("conv_id").alias("_b"), "pos", "digest", "length")
    lead = first.join(cut_, (first["_b"] == cut_["base"]) & (F.col("pos") < F.col("head")))
    lead = lead.select(F.col("_c").alias("conv_id"), F.col("pos").alias("q"), "digest", "length", "size")
    return tail.unionByName(lead), sizes.select("conv_id", "size")


def _segment_sums(seg: Column, key: Column) -> list[Column]:
    """Two 40-bit numbers of a segment; their sums over the segments before name a prefix."""
    text = F.concat(seg.cast("string"), F.lit(":"), F.hex(key)).cast("binary")
    return [F.conv(F.substring(F.md5(text), at, 10), 16, 10).cast("bigint") for at in (1, 11)]


def segments(turns: DataFrame, sizes: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, a1, a2, key, lens, ends): the digests of up to ``segment`` turns and the node they hang at."""
    cut_ = turns.withColumn("seg", F.floor(F.col("q") / segment).cast("bigint"))
    parts = cut_.groupBy("conv_id", "seg", "size").agg(F.array_sort(F.collect_list(F.struct("q", F.hex("digest").alias("d"), "length"))).alias("t"))
    parts = parts.select(
        "conv_id", "seg", F.unhex(F.array_join(F.col("t.d"), "")).alias("key"), F.col("t.length").alias("lens"), (F.col("size") <= (F.col("seg") + 1) * segment).alias("ends")
    )
    bare = sizes.where("size = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("seg"), F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("lens"), F.lit(True).alias("ends")
    )
    parts = stored(parts.unionByName(bare))
    zero = F.lit(0).cast("bigint")
    short = parts.withColumn("a1", zero).withColumn("a2", zero)
    if parts.where("NOT ends").isEmpty():
        return short
    long = parts.select("conv_id", "seg", *[c.alias(f"s{i}") for i, c in enumerate(_segment_sums(F.col("seg"), F.col("key")), 1)])
    for i in (1, 2):
        order = ["conv_id", "seg"]
        long = long.repartitionByRange(*order).sortWithinPartitions(*order)
        long = with_rank(numbered_locally(long, "conv_id", f"s{i}", ordered=True), "conv_id", f"a{i}", f"s{i}", ordered=True)
    long = long.where("seg > 0").select(F.col("conv_id").alias("_c"), F.col("seg").alias("_s"), F.col("a1").alias("_1"), F.col("a2").alias("_2"))
    met = short.join(long, (short["conv_id"] == long["_c"]) & (short["seg"] == long["_s"]), "left")
    return met.select("conv_id", "seg", "key", "lens", "ends", *[F.coalesce(f"_{i}", zero).alias(f"a{i}") for i in (1, 2)])


def sequences(parts: DataFrame) -> DataFrame:
    """Distinct sequences with their members; ``next`` names the node at their end if some member goes on."""
    rows = parts.groupBy(*ANCHOR, "key", "lens").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end")
    )
    s1, s2 = _segment_sums(F.col("seg"), F.col("key"))
    after = _anchor(F.col("seg") + 1, F.col("a1") + s1, F.col("a2") + s2)
    return rows.select("*", _anchor(*map(F.col, ANCHOR)).alias("anchor"), F.when(F.col("n_ends") < F.col("n"), after).alias("next"))


def _anchor(seg: Column, a1: Column, a2: Column) -> Column:
    return F.concat_ws(":", seg.cast("string"), a1.cast("string"), a2.cast("string"))


# --- forests ------------------------------------------------------------------------------------------------------------


class Node:
    """What is known of one node: members, least id, children, leaves and saved tokens below, ends, and names others know it by."""

    __slots__ = ("n", "least", "kids", "leaves", "saved", "n_ends", "end", "refs")

    def __init__(self, n=0, least=None, kids=0, leaves=0, saved=0, n_ends=0, end=None, refs=()):
        self.n, self.least, self.kids, self.leaves, self.saved, self.n_ends, self.end, self.refs = n, least, kids, leaves, saved, n_ends, end, refs

    def add(self, other: Node) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.n_ends += other.n_ends
        self.end = other.end if self.end is None else self.end
        self.refs = tuple(sorted({*self.refs, *other.refs}))

    def values(self) -> list:
        return [getattr(self, k) for k in self.__slots__]


class Path:
    """A sequence and the (partial) nodes on its way, by depth."""

    __slots__ = ("anchor", "key", "lens", "hung")

    def __init__(self, anchor: str, key: bytes, lens: list[int], hung: list[tuple[int, Node]]):
        self.anchor, self.key, self.lens, self.hung = anchor, key, lens, hung


class Component:
    __slots__ = ("path", "depth", "node", "hung", "first", "last", "children")

    def __init__(self, path: Path, first: bool, last: bool):
        self.path, self.hung, self.first, self.last, self.children = path, sorted(path.hung, key=lambda x: x[0]), first, last, []
        self.depth, self.node = self.hung.pop()


def common(a: Path, b: Path) -> int:
    """Turns that two sequences share from their common anchor on; -1 without one."""
    if a.anchor != b.anchor:
        return -1
    x, y, d = a.key, b.key, 0
    most = min(len(x), len(y))
    while d < most and x[d : d + DIGEST] == y[d : d + DIGEST]:
        d += DIGEST
    return d // DIGEST


def grow(paths: list[Path], open_: bool) -> tuple[list[dict], list[Path]]:
    """Final chains of nodes of sorted sequences and, if neighbours may follow on both sides, the contracted forest (at most two paths)."""
    chains: list[dict] = []
    kept: dict[str, list[tuple[int, Node]]] = {"first": [], "last": []}
    size = len(paths)
    comps = [Component(p, open_ and i == 0, open_ and i == size - 1) for i, p in enumerate(paths)]
    root = list(range(size))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def leave(c: Component, above: int) -> None:
        """The node of ``c`` is complete as far as these sequences go; ``above``: depth of the next node on the way up."""
        node, path = c.node, c.path
        if c.first or c.last:
            if node.n:
                ref = hashlib.md5(f"{path.anchor}/{c.depth}/".encode() + path.key[: c.depth * DIGEST]).hexdigest()
                for child in c.children:
                    child["parent_ref"] = ref
                node.refs = tuple(sorted({*node.refs, ref})) if c.children else node.refs
                kept["first" if c.first else "last"].append((c.depth, node))
            c.node, c.children = Node(), []
            return
        if not node.kids:
            node.leaves = 1
        saved, below = [], node.saved
        for d in range(c.depth, above, -1):
            below += (node.n - 1) * (path.lens[d - 1] if d else 0)
            saved.append(below)
        for child in c.children:
            child["parent_conv_id"] = node.least
        chain = {
            "anchor": path.anchor, "conv_id": node.least, "low": above + 1, "high": c.depth, "n_convs": node.n, "n_children": node.kids,
            "n_leaves": node.leaves, "saved": saved[::-1], "n_ends": node.n_ends, "end": node.end, "refs": list(node.refs),
        }
        chains.append(chain)
        c.node, c.children = Node(node.n, node.least, 1, node.leaves, below), [chain]

    def rise(c: Component, depth: int) -> None:
        while c.depth > depth:
            above = max(depth, c.hung[-1][0]) if c.hung else depth
            leave(c, above)
            c.depth = above
            if c.hung and c.hung[-1][0] == above:
                c.node.add(c.hung.pop()[1])

    edges = [(common(paths[i], paths[i + 1]), i) for i in range(size - 1)]
    for depth, i in sorted(edges, key=lambda e: (-e[0], e[1])):
        if depth < 0:
            break
        i, j = find(i), find(i + 1)
        a, b = comps[i], comps[j]
        rise(a, depth)
        rise(b, depth)
        if len(a.children) < len(b.children):
            a.children, b.children = b.children, a.children
        a.children.extend(b.children)
        a.node.add(b.node)
        if b.hung:
            both: dict[int, Node] = dict(a.hung)
            for d, node in b.hung:
                both.setdefault(d, Node()).add(node)
            a.hung = sorted(both.items(), key=lambda x: x[0])
        a.first, a.last = a.first or b.first, a.last or b.last
        root[j] = i
    for i in range(size):
        if root[i] == i:
            c = comps[i]
            rise(c, 0)
            if not c.path.anchor.startswith("0:"):  # the node that a later segment hangs at belongs to the segment before
                for child in c.children:
                    child["parent_ref"] = c.path.anchor
                c.children = []
            leave(c, -1)
    ends = [paths[0], paths[-1]][: min(size, 2)] if open_ else []
    return chains, [Path(p.anchor, p.key, p.lens, kept[side]) for p, side in zip(ends, ("first", "last"))]


CHAIN = (
    "anchor string, conv_id bigint, low int, high int, n_convs bigint, n_children bigint, n_leaves bigint, saved array<bigint>, n_ends bigint, end bigint, "
    "refs array<string>, parent_conv_id bigint, parent_ref string"
)
FOREST = f"{CHAIN}, task bigint, place int, key binary, lens array<bigint>, hung string"


def _open_rows(paths: list[Path], task: int) -> list[dict]:
    return [
        {"anchor": p.anchor, "task": task, "place": k, "key": p.key, "lens": list(p.lens), "hung": json.dumps([[d, n.values()] for d, n in p.hung])}
        for k, p in enumerate(paths)
    ]


def _path_of(row: dict) -> Path:
    return Path(row["anchor"], bytes(row["key"]), [int(x) for x in row["lens"]], [(d, Node(*v[:-1], tuple(v[-1]))) for d, v in json.loads(row["hung"])])


def _blocks(schema: pa.Schema, block_rows: int):
    """Forests of a task's sorted sequences: block by block, each merged with the contracted forest before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, state, block, size = TaskContext.get().partitionId(), [], [], 0
        for b in batches:
            for r in b.to_pylist():
                node = Node(r["n"], r["least"], r["kids"], r["leaves"], r["saved"], r["n_ends"], r["end"], (r["next"],) if r["next"] else ())
                block.append(Path(r["anchor"], r["key"], r["lens"], [(len(r["key"]) // DIGEST, node)]))
                size += len(r["key"])
                if len(block) >= block_rows or size >= BLOCK_BYTES:
                    chains, state = grow([*state, *block], True)
                    block, size = [], 0
                    yield pa.RecordBatch.from_pylist(chains, schema)
        if block:
            chains, state = grow([*state, *block], True)
            yield pa.RecordBatch.from_pylist(chains, schema)
        yield pa.RecordBatch.from_pylist(_open_rows(state, task), schema)

    return run


def _merge(columns: list[str], fan: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "place"])
        paths = [_path_of(r) for r in pdf[["anchor", "key", "lens", "hung"]].to_dict("records")]
        chains, state = grow(paths, not last)
        rows = chains + _open_rows(state, int(pdf["task"].iloc[0]) // fan)
        return pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None) if rows else pd.DataFrame(columns=columns)

    return run


def forest(rows: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """All chains of the sequences' tries; the forests of the tasks are merged in a tree."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    columns = StructType.fromDDL(FOREST).fieldNames()
    order = [*ANCHOR, "key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(rows.mapInArrow(_blocks(to_arrow_schema(StructType.fromDDL(FOREST)), block_rows), FOREST))
    tasks = found.agg(F.max("task")).first()[0]
    out = []
    while tasks is not None:
        out.append(found.where("hung IS NULL"))
        group = F.floor(F.col("task") / fan).alias("_group")
        found = stored(found.where("hung IS NOT NULL").groupBy(group).applyInPandas(_merge(columns, fan, tasks < fan), FOREST))
        tasks = tasks // fan if tasks >= fan else None
    out.append(found.where("hung IS NULL"))
    chains = out[0]
    for more in out[1:]:
        chains = chains.unionByName(more)
    return chains.select(*StructType.fromDDL(CHAIN).fieldNames())


def below_anchors(rows: DataFrame, **sizes: int) -> DataFrame:
    """(next, kids, leaves, saved) of the nodes that segments hang at, with all later segments below them.

    A first run of the forests gives the sums of each anchor's own segment; sums over the tree of anchors are then taken by
    doubling: after k rounds an anchor has the sums of all anchors less than 2^k below it and knows the one 2^k above.
    """
    plain = rows.select("*", F.col("next").isNotNull().cast("int").alias("kids"), F.lit(0).alias("leaves"), F.lit(0).alias("saved"))
    own = forest(plain, **sizes).where("high = 0 AND NOT startswith(anchor, '0:')")
    own = own.select("anchor", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved")[0].alias("saved"))
    above = rows.where("next IS NOT NULL").select(F.col("next").alias("_n"), F.when(~F.startswith("anchor", F.lit("0:")), F.col("anchor")).alias("up"))
    tree = stored(own.join(above, own["anchor"] == above["_n"]).drop("_n"))
    while not tree.where("up IS NOT NULL").isEmpty():
        given = tree.where("up IS NOT NULL").groupBy(F.col("up").alias("_a")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        higher = tree.select(F.col("anchor").alias("_b"), F.col("up").alias("_u"))
        tree = tree.join(given, tree["anchor"] == given["_a"], "left").join(higher, tree["up"] == higher["_b"], "left")
        add = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias(own)
        tree = stored(tree.select("anchor", "kids", add("leaves", "_l"), add("saved", "_s"), F.col("_u").alias("up")))
    return tree.select(F.col("anchor").alias("_n"), "kids", "leaves", "saved")


def nodes(parts: DataFrame, segment: int = SEGMENT, **sizes: int) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends and end
    (number and least id of the conversations that end there)."""
    rows = stored(sequences(parts))
    if rows.where("next IS NOT NULL").isEmpty():
        rows = rows.select("*", *[F.lit(0).alias(n) for n in ("kids", "leaves", "saved")])
    else:
        below = below_anchors(rows, **sizes)
        rows = rows.join(below, rows["next"] == below["_n"], "left").drop("_n").fillna(0, ["kids", "leaves", "saved"])
    chains = stored(forest(rows, **sizes))
    named = chains.select(F.explode("refs").alias("_r"), F.col("conv_id").alias("_p"))
    apart = chains.where("parent_ref IS NOT NULL").join(named, F.col("parent_ref") == F.col("_r"))
    chains = chains.where("parent_ref IS NULL").unionByName(apart.withColumn("parent_conv_id", F.col("_p")).drop("_r", "_p"))
    start = F.split_part("anchor", F.lit(":"), F.lit(1)).cast("bigint") * segment
    each = chains.where("high > 0 OR startswith(anchor, '0:')").select("*", start.alias("start"), F.posexplode("saved").alias("k", "saved_tokens"))
    bottom = F.col("low") + F.col("k") == F.col("high")
    return each.select(
        "conv_id",
        (F.col("start") + F.col("low") + F.col("k")).cast("bigint").alias("depth"),
        F.when(F.col("k") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(bottom, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.when(bottom, F.col("n_ends")).otherwise(0).cast("bigint").alias("n_ends"),
        F.when(bottom, F.col("end")).alias("end"),
    )


# --- digests of members -------------------------------------------------------------------------------------------------


def _id_texts(schema: pa.Schema, piece: int):
    """Joined ids of the groups of a task's sorted (group, id) rows: digests of groups that lie within, pieces of those at its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, at_start = TaskContext.get().partitionId(), [], True
        rows = (r for b in batches for r in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()))

        def give(node: bytes, least: int, k: int, ids: list[int], whole: bool) -> None:
            text = ",".join(map(str, ids))
            if whole:
                if len(ids) > 1:
                    out.append({"end": least, "sha": hashlib.sha256(text.encode()).hexdigest()})
            else:
                out.append({"node": node, "task": task, "k": k, "end": least, "ids": text})

        held: tuple | None = None
        for node, group in groupby(rows, key=lambda r: r[0]):
            if held:
                give(*held, held[2] == 0 and not at_start)
                at_start = False
            k, ids, least = 0, [], None
            for _, conv in group:
                least = conv if least is None else least
                ids.append(conv)
                if len(ids) == piece:
                    give(node, least, k, ids, False)
                    k, ids = k + 1, []
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
            held = (node, least, k, ids)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if held:
            give(*held, False)
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _id_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of groups whose sorted pieces come one after another; one piece is held at a time."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, group in groupby(rows, key=lambda r: r["node"]):
        sha, least = hashlib.sha256(), None
        for r in group:
            if r["ids"]:
                sha.update((b"" if least is None else b",") + r["ids"].encode())
                least = r["end"] if least is None else least
        if least is not None:
            yield pa.RecordBatch.from_pylist([{"end": least, "sha": sha.hexdigest()}], pa.schema([("end", pa.int64()), ("sha", pa.string())]))


def end_digests(parts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(end, sha): per node with several ending conversations the least of them and SHA-256 of all, ascending and comma-joined."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    node = F.unhex(F.md5(F.concat(_anchor(*map(F.col, ANCHOR)), F.lit("/"), F.hex("key")).cast("binary")))
    rows = parts.where("ends").select(node.alias("node"), "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    schema = "node binary, task int, k int, end bigint, ids string, sha string"
    found = stored(rows.mapInArrow(_id_texts(to_arrow_schema(StructType.fromDDL(schema)), piece), schema))
    pieces = found.where("sha IS NULL").repartition("node").sortWithinPartitions("node", "task", "k")
    return found.where("sha IS NOT NULL").select("end", "sha").unionByName(pieces.mapInArrow(_id_digests, "end bigint, sha string"))


def with_end_digests(tree: DataFrame, parts: DataFrame, piece: int = PIECE) -> DataFrame:
    """The nodes with ``ends_sha256``; a single id is digested in place."""
    many = end_digests(parts, piece).select(F.col("end").alias("_e"), "sha")
    out = tree.join(many, F.col("end") == F.col("_e"), "left")
    one = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    return out.withColumn("ends_sha256", F.when(F.col("n_ends") > 1, F.col("sha")).otherwise(one)).drop("_e", "sha")
