"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

The alphabet is words (64-bit hashes). Patterns of one length form a group with three tables: the shift table says for a
block of two words how far the search may jump when the block ends at the current place; the suffix table lists the
patterns that end with a block whose shift is zero; direct comparison, first of all words' hashes and then of the words
themselves, confirms an occurrence. Many texts are searched side by side, one lane for each run of ``LANE`` places.

Benchmark items are a stated query set. They are split into blocks of at most ``BLOCK_WINDOWS`` windows, each of which is
broadcast on its own, and the documents run through the blocks one after the other, without a shuffle.

Defined cases: null and empty texts have no words, are never hit and match no item; an item without words has no window,
one with fewer than ``window`` words is one window; repeated items and rows are kept apart; an empty benchmark leaves
every document clean; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import forget, kept, lean, replace_columns, type_of
from queryscope.llm.wordhash import NOT_ALNUM, Words, chained, mix, runs_inside, slices

WINDOW = 10
#: windows in one broadcast: 80 bytes of hashes each and their words
BLOCK_WINDOWS = 200_000
#: places searched by one lane
LANE = 128
#: entries of a shift table
TABLE = 1 << 20


@dataclass
class Group:
    """Tables of the patterns of one length (in words)."""

    size: int
    shift: np.ndarray
    suffix: np.ndarray  # block hashes in order
    hashes: np.ndarray  # patterns in the order of their suffix, one row each
    words: list[bytes]  # the same patterns, words joined by a blank
    items: list[np.ndarray]  # positions of their items


def blocks_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each place; a block is two words, or one where patterns have one."""
    if size == 1:
        return mix(hashes.copy())
    out = mix(np.full(len(hashes), 7, np.uint64))
    out[1:] = chained(hashes, 2)
    return out


def build_group(patterns: dict[bytes, tuple[np.ndarray, set[int]]], size: int) -> Group:
    """Tables from words -> (hashes, item positions)."""
    width = min(2, size)
    texts = list(patterns)
    hashes = np.array([patterns[t][0] for t in texts], np.uint64).reshape(len(texts), size)
    shift = np.full(TABLE, size - width + 1, np.int32)
    for end in range(width, size + 1):
        part = np.ascontiguousarray(hashes[:, end - width : end])
        ends = mix(part[:, 0].copy()) if width == 1 else _pair(part)
        np.minimum.at(shift, (ends & np.uint64(TABLE - 1)).astype(np.int64), size - end)
    suffix = mix(hashes[:, -1].copy()) if width == 1 else _pair(np.ascontiguousarray(hashes[:, -2:]))
    order = np.argsort(suffix, kind="stable")
    return Group(size, shift, suffix[order], hashes[order], [texts[i] for i in order], [np.array(sorted(patterns[texts[i]][1])) for i in order])


def _pair(two: np.ndarray) -> np.ndarray:
    out = two[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    out += two[:, 1]
    return mix(out)


def build(texts: list[str | None], window: int = WINDOW) -> list[Group]:
    """Groups of all windows of the items; an item's position in ``texts`` names it."""
    by_size: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for i, _, w in slices(pa.array(texts, pa.string()), NOT_ALNUM):
        for k in range(len(w.first) - 1):
            lo, hi = w.first[k], w.first[k + 1]
            size = int(min(window, hi - lo))
            for s in range(lo, hi - size + 1) if size else ():
                text = b" ".join(w.word(j) for j in range(s, s + size))
                by_size.setdefault(size, {}).setdefault(text, (w.hashes[s : s + size].copy(), set()))[1].add(i + k)
    return [build_group(p, n) for n, p in sorted(by_size.items())]


def search(words: Words, group: Group) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every confirmed occurrence."""
    n = group.size
    starts, bounds = runs_inside(words.first, n)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none
    blocks = blocks_of(words.hashes, n)
    slots = (blocks & np.uint64(TABLE - 1)).astype(np.int64)
    # lanes: at most LANE neighbouring ends inside one text; ``starts`` are contiguous inside a text
    lo = np.concatenate([np.arange(a, b, LANE) for a, b in zip(bounds[:-1], bounds[1:])]) if len(bounds) < 64 else _cuts(bounds)
    text_end = bounds[np.searchsorted(bounds, lo, "right")]
    hi = np.minimum(lo + LANE, text_end)
    place, stop = starts[lo] + n - 1, starts[hi - 1] + n - 1
    found = []
    while len(place):
        jump = group.shift[slots[place]]
        zero = jump == 0
        if zero.any():
            found.append(place[zero])
        place = place + np.maximum(jump, 1)
        live = place <= stop
        place, stop = place[live], stop[live]
    if not found:
        none = np.empty(0, np.int64)
        return none, none
    ends = np.concatenate(found)
    left = np.searchsorted(group.suffix, blocks[ends], "left")
    right = np.searchsorted(group.suffix, blocks[ends], "right")
    out_s, out_p = [], []
    step = left.copy()
    while True:  # one pattern of each place's bucket at a time
        live = step < right
        if not live.any():
            break
        ends, step, right = ends[live], step[live], right[live]
        at = ends[:, None] - np.arange(n - 1, -1, -1)
        same = (words.hashes[at] == group.hashes[step]).all(1)
        for e, p in zip(ends[same], step[same]):
            s = e - n + 1
            if b" ".join(words.word(j) for j in range(s, e + 1)) == group.words[p]:
                out_s.append(s)
                out_p.append(p)
        step = step + 1
    return np.array(out_s, np.int64), np.array(out_p, np.int64)


def _cuts(bounds: np.ndarray) -> np.ndarray:
    lanes = -(-np.diff(bounds) // LANE)
    first = np.concatenate([[0], np.cumsum(lanes)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], lanes)
    return np.repeat(bounds[:-1], lanes) + k * LANE


def _scan(column: pa.Array, groups: list[Group], base: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: number of words, hit words (places), item positions (plus ``base``)."""
    counts, hit, items = [], [], []
    for i, j, w in slices(column, NOT_ALNUM):
        counts.append(np.diff(w.first))
        own_hit: dict[int, list[np.ndarray]] = {}
        own_items: dict[int, list[np.ndarray]] = {}
        for g in groups:
            starts, patterns = search(w, g)
            docs = np.searchsorted(w.first, starts, "right") - 1
            for s, p, d in zip(starts, patterns, docs):
                own_hit.setdefault(d, []).append(np.arange(s, s + g.size) - w.first[d])
                own_items.setdefault(d, []).append(g.items[p] + base)
        none = np.empty(0, np.int64)
        for d in range(j - i):
            hit.append(np.unique(np.concatenate(own_hit[d])) if d in own_hit else none)
            items.append(np.unique(np.concatenate(own_items[d])) if d in own_items else none)
    return np.concatenate(counts) if counts else np.empty(0, np.int64), hit, items


def _joined(old: list, new: list[np.ndarray]) -> list[np.ndarray]:
    return [np.union1d(np.array(a, np.int64), b) if len(b) and len(a) else (b if len(b) else np.array(a, np.int64)) for a, b in zip(old, new)]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of about ``limit`` windows, streamed from Spark one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"] or "") // 6 + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``keep`` columns of every row, n_words, hit_words (places of the words hit) and item_ids (as strings, sorted)."""
    spark = docs.sparkSession
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    kept_columns = rows.columns
    fields = ", ".join(f"`{c}` {type_of(rows, c)}" for c in kept_columns)
    schema = f"{fields}, _n bigint, _hit array<bigint>, _items array<string>"
    blocks = item_blocks(benchmark, item_id, item_text, block_windows)
    block, first, path = next(blocks, []), True, None
    while block is not None:
        after = next(blocks, None)
        sent = spark.sparkContext.broadcast((build([t for _, t in block], window), [i for i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            groups, ids = sent.value
            for b in batches:
                n, hit, places = _scan(b.column(text_col), groups, 0)
                names = [[ids[k] for k in p] for p in places]
                if not first:
                    hit = _joined(b.column("_hit").to_pylist(), hit)
                    names = [[*a, *c] for a, c in zip(b.column("_items").to_pylist(), names)]
                yield replace_columns(
                    b, kept_columns, _n=pa.array(n, pa.int64()), _hit=pa.array(hit, pa.list_(pa.int64())), _items=pa.array(names, pa.list_(pa.string()))
                )

        rows, first, block = rows.mapInArrow(lean(run), schema), False, after
        if after is not None:  # the next block needs the room: write what this one found, then let go of its patterns
            before = path
            rows, path = kept(rows)
            sent.destroy()
            if before:
                forget(spark, before)
    return rows.select(
        *keep, F.col("_n").alias("n_words"), F.col("_hit").alias("hit_words"), F.array_sort(F.array_distinct("_items")).alias("item_ids")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs, benchmark, [id_col], **options)
    n_hit = F.size("hit_words").cast("bigint")
    return hits.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
