"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A row descends it: at each level every child draws ``-ln(u) / weight`` with ``u``
from a hash of the key and the child's path, and the least draw wins. A child's draw depends on its own path and weight
only, so a changed weight moves rows into or out of that child's subtree alone. A shard added as a region of its own
takes rows only into itself.

Defined cases: a null key is hashed as the empty text; null text has size 1 and crc32 0; repeated rows get the same
shard and different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from queryscope.llm.common import numbered_locally, with_rank

Tree = dict[str, "Tree | float"]


def weight_of(node: Tree | float) -> float:
    """A leaf's weight, or the sum of a subtree's leaves."""
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column, path: str, weight: float) -> Column:
    """Exponential draw of one child: the least of all draws wins with a chance in proportion to the weight."""
    digits = F.substring(F.md5(F.concat(F.lit(path + "\u0001"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(weight)


def descend(key: Column, tree: Tree, path: str = "") -> Column:
    """Name of the leaf that a key reaches."""
    names = [n for n, sub in tree.items() if weight_of(sub) > 0]
    if not names:
        raise ValueError("a subtree needs a positive weight")

    def below(name: str) -> Column:
        sub = tree[name]
        return descend(key, sub, f"{path}/{name}") if isinstance(sub, dict) else F.lit(name)

    if len(names) == 1:
        return below(names[0])
    draws = [draw(key, f"{path}/{n}", weight_of(tree[n])) for n in names]
    least = F.least(*draws)
    out = below(names[-1])
    for name, d in list(zip(names, draws))[-2::-1]:
        out = F.when(d == least, below(name)).otherwise(out)
    return out


def two_regions(shards: int) -> Tree:
    """Equal shards 0.. in two regions of racks of two."""
    names = list(range(shards))
    half = (shards + 1) // 2
    regions = [names[:half], names[half:]]
    return {f"region{r}": {f"rack{k // 2}": {str(n): 1.0 for n in part[k : k + 2]} for k in range(0, len(part), 2)} for r, part in enumerate(regions) if part}


def grown(tree: Tree, name: str, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own."""
    return {**tree, f"region-{name}": {"rack0": {name: weight}}}


def shard_documents(docs: DataFrame, tree: Tree, more: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (bytes + 1), text_crc32, law, shard, slot (0.. in the shard), grown_shard (in the tree ``more``).

    Texts never leave the scan: the size and checksum are taken there, and only narrow rows are numbered.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, more).cast("int").alias("grown_shard"),
    )
    return with_rank(numbered_locally(rows, "shard"), "shard", "slot")
