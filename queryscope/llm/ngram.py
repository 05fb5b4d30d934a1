"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 has the words in order of their hash, with counts. A level above holds for each context (an entry of the level
below) the words that follow it: the entries of all contexts of a shard form one growing sequence in Elias-Fano form,
monotone pointers tell where each context's entries begin, and a word is found by successor search between its context's
pointers. Every entry has its smoothed probability, every context its backoff weight, both quantised to one byte on a
logarithmic scale. Probabilities are interpolated with absolute discounting; entries seen fewer than ``MIN_COUNT`` times
are pruned and their mass goes to the backoff.

Counting runs on Spark: each task counts its own texts in arrays and sends sorted blocks. Contexts decide the shard; above
level 1 a shard whose contexts were seen more than ``PART_TOKENS`` times is parted by a hash of the key, so that even a
word with a third of all tokens brings bounded blocks to a task. The task adds its blocks up, prunes, and writes a sorted run to
the shared checkpoint folder. A shard's runs are then merged by key range: each range of about ``RANGE`` entries and
contexts is a file of its own, and a hot context's entries may lie in several. Sizes, range borders and a sample of a
parted shard's keys reach the driver; scoring tasks map the files into memory, so that workers of a machine share them.
The number of shards grows with the rows.

Defined cases: null counts as the empty text, whose only token is the end; unknown words have count 0; without training
rows the score equals the base score, whose formula then gives 0 for each token; repeated rows are scored each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from queryscope.llm import eliasfano as ef
from queryscope.llm.common import replace_columns, type_of
from queryscope.llm.wordhash import WHITE, slices
from queryscope.session import cut, ensure_checkpoint_dir

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.6
#: the token after the last word; no word has this hash but by a chance of 2**-64
END = np.uint64(0xE4D0_0000_0000_0001)
#: tokens counted in a task before it sends its blocks
FLUSH = 3_000_000
#: tokens of a shard's contexts for each part that is summed on its own
PART_TOKENS = 4_000_000
#: entries, and contexts, of a range of a shard
RANGE = 2_000_000
#: one key in so many is sampled for the range borders
STEP = 256
#: training rows per shard
ROWS_PER_SHARD = 8_000


def with_ends(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with an end after each text, and each text's first token."""
    n = len(first) - 1
    bounds = first + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))] = hashes
    return out, bounds


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per value on an even scale between the least and the greatest, and that scale."""
    if not len(logs):
        return np.empty(0, np.uint8), np.zeros(2)
    lo, hi = float(logs.min()), float(logs.max())
    step = (hi - lo) / 255 or 1.0
    return np.rint((logs - lo) / step).astype(np.uint8), np.array([lo, step])


@dataclass
class Layout:
    """What every task must know of the model: its folder and the sizes of the shards (a few numbers each)."""

    folder: str
    shards: int
    words: list[int]  # per shard
    tokens: int
    entries: list[list[list[tuple[int, int]]]]  # per level from 2 on, per shard: (first key, entries) of each range


class Shard:
    """Mapped ranges of one shard of a level; entries are numbered through."""

    def __init__(self, folder: str, name: str, ranges: list[tuple[int, int]], vocabulary: int):
        self.vocabulary = np.uint64(vocabulary)
        self.start = np.array([k for k, _ in ranges], np.uint64)
        self.context = (self.start // self.vocabulary).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum([n for _, n in ranges])]).astype(np.int64)
        files = [ef.read_arrays(folder, f"{name}-{r}") for r in range(len(ranges))]
        self.files = [(ef.Sequence(a, "e."), ef.Sequence(a, "p."), a) for a in files]

    def _by_range(self, place: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
        if len(self.files) == 1:
            yield 0, slice(None)
        else:
            for r in np.unique(place):
                yield int(r), np.flatnonzero(place == r)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry or -1, log10 probability, log10 backoff weight) of words (-1: unknown) after contexts."""
        entry, prob, back = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(word))
        keys = context.astype(np.uint64) * self.vocabulary + np.maximum(word, 0).astype(np.uint64)
        for r, own in self._by_range(np.searchsorted(self.start, keys, "right") - 1):
            entries, pointers, a = self.files[r]
            ctx, known = context[own] - self.context[r], word[own] >= 0
            lo, hi = pointers.get(ctx).astype(np.int64), pointers.get(ctx + 1).astype(np.int64)
            some = np.flatnonzero((lo < hi) & known)
            at = np.full(len(ctx), -1, np.int64)
            values = keys[own][some] - np.uint64(self.context[r]) * self.vocabulary
            at[some] = entries.find(values, lo[some], hi[some])
            entry[own] = np.where(at >= 0, at + self.first[r], -1)
            if len(a["prob"]):
                prob[own] = a["prob.scale"][0] + a["prob"][np.maximum(at, 0)] * a["prob.scale"][1]
            # a border's context may have entries in other ranges only
            there = (lo < hi) | (ctx == 0) | (ctx == len(a["back"]) - 1)
            back[own] = np.where(there, a["back.scale"][0] + a["back"][ctx] * a["back.scale"][1], 0.0)
        return entry, prob, back

    def at(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, count) of entries."""
        word, count = np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
        for r, own in self._by_range(np.searchsorted(self.first, entry, "right") - 1):
            entries, _, a = self.files[r]
            place = entry[own] - self.first[r]
            word[own], count[own] = (entries.get(place) % self.vocabulary).astype(np.int64), a["count"][place]
        return word, count


class Trie:
    """Mapped levels of a model."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.bits = layout.shards.bit_length() - 1
        self.start = np.concatenate([[0], np.cumsum(layout.words)]).astype(np.int64)
        self.vocabulary = int(self.start[-1])
        self.unit = 0.5 * (self.vocabulary + 1) + layout.tokens
        self.first = [ef.read_arrays(layout.folder, f"1-{s}") if n else None for s, n in enumerate(layout.words)]
        self.levels = []
        for level, sizes in enumerate(layout.entries, 2):
            self.levels.append([Shard(layout.folder, f"{level}-{s}", n, self.vocabulary) if n else None for s, n in enumerate(sizes)])

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(self.shard_of(hashes), np.arange(self.layout.shards + 1))
        for s, a in enumerate(self.first):
            part = slice(edges[s], edges[s + 1])
            if a is None or part.start == part.stop:
                continue
            at = np.minimum(np.searchsorted(a["hash"], hashes[part]), len(a["hash"]) - 1)
            known = a["hash"][at] == hashes[part]
            ids[part] = np.where(known, at + self.start[s], -1)
            counts[part] = np.where(known, a["count"][at], 0)
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.unit)

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids in any order."""
        out, shard = np.zeros(len(ids), np.int64), np.searchsorted(self.start, ids, "right") - 1
        for s in np.unique(shard):
            own = shard == s
            out[own] = self.first[s]["count"][ids[own] - self.start[s]]
        return out

    def follow(self, level: int, shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry or -1, log10 probability, log10 backoff weight) for contexts (places in a shard of the level below).

        Queries are ordered by shard; a context without entries has weight 1.
        """
        entry, prob, back = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(word))
        edges = np.searchsorted(shard, np.arange(self.layout.shards + 1))
        for s, data in enumerate(self.levels[level - 2]):
            part = slice(edges[s], edges[s + 1])
            if data is None or part.start == part.stop:
                continue
            entry[part], prob[part], back[part] = data.find(context[part], word[part])
        return entry, prob, back


def _distinct_words(trie: Trie, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, count) of each token."""
    one, back = np.unique(hashes, return_inverse=True)
    ids, counts = trie.words(one)
    return ids[back], counts[back]


def _bigrams(trie: Trie, ids: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
    """(shard, entry, log10 probability, log10 weight) of the pairs (i - 1, i) for the places ``where``; contexts known."""
    a, b = ids[where - 1].astype(np.uint64), (ids[where] + 1).astype(np.uint64)
    keys, back = np.unique((a << np.uint64(32)) | b, return_inverse=True)
    left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
    shard = np.searchsorted(trie.start, left, "right") - 1
    entry, prob, weight = trie.follow(2, shard, left - trie.start[shard], right)
    return shard[back], entry[back], prob[back], weight[back]


def _inside(bounds: np.ndarray, back: int) -> np.ndarray:
    """Places with at least ``back`` tokens before them in their text."""
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.flatnonzero(place >= back)


Counts = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _counted(rows: DataFrame, text_col: str, parts: list[int], keys_of: Callable[[], Counts]) -> DataFrame:
    """(part, keys, counts): each task's sorted blocks. ``keys_of()`` gives a function from tokens to (shard, key).

    ``parts``: number of parts of each shard; they are numbered through.
    """
    first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, size = keys_of(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            shard = np.concatenate([s for s, _ in held])
            key = np.concatenate([k for _, k in held])
            held.clear()
            if first[-1] > len(parts):
                mixed = ((key ^ (key >> np.uint64(32))) * np.uint64(0x9E37_79B9_7F4A_7C15)) >> np.uint64(33)
                shard = (first[shard] + (mixed % np.array(parts, np.uint64)[shard]).astype(np.int64)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard, key = shard[order], key[order]
            edges = np.searchsorted(shard, np.arange(first[-1] + 1))
            for s in np.flatnonzero(np.diff(edges)):
                k, n = np.unique(key[edges[s] : edges[s + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([n.astype(np.uint32).tobytes()], pa.binary())],
                    names=["part", "keys", "counts"],
                )

        for b in batches:
            for _, _, w in slices(b.column(0), WHITE):
                s, k = make(*with_ends(w.hashes, w.first))
                held.append((s.astype(np.int32), k))
                size += len(k)
                if size >= FLUSH:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return rows.select(text_col).mapInArrow(run, "part int, keys binary, counts binary")


def _built(blocks: DataFrame, parts: int, write: Callable[[int, np.ndarray, np.ndarray], tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Run ``write`` for every part with its keys and counts; what it returns, per part."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        n, m, sample = write(p, *_summed(keys, counts))
        return pa.table({"part": pa.array([p], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([m], pa.int64()), "sample": pa.array([sample], pa.binary())})

    rows = blocks.groupBy("part").applyInArrow(run, "part int, n bigint, m bigint, sample binary").collect()
    got = {r["part"]: (r["n"], r["m"], bytes(r["sample"])) for r in rows}
    return [got.get(p, (0, 0, b"")) for p in range(parts)]


def _borders(entries: int, contexts: int, vocabulary: int, sample: np.ndarray) -> list[int]:
    """First keys of a shard's ranges, from a sorted sample of its keys: about ``RANGE`` entries and contexts each."""
    pieces = -(-entries // RANGE)
    by_entries = [int(sample[k * len(sample) // pieces]) for k in range(1, pieces)] if len(sample) else []
    return sorted({0, *by_entries, *(c * vocabulary for c in range(RANGE, contexts, RANGE))})


def _range(folder: str, name: str, runs: list[dict[str, np.ndarray]], start: int, end: int, vocabulary: int, total, lower) -> int:
    """Merge the keys from ``start`` to ``end`` of a shard's runs into a file; ``total(context)`` are the contexts' counts,
    ``lower(context, word)`` lower log10 probabilities. The number of its entries."""
    cuts = [np.searchsorted(a["keys"], np.array([start, end], np.uint64)) for a in runs]
    keys = np.concatenate([a["keys"][i:j] for a, (i, j) in zip(runs, cuts)])
    counts = np.concatenate([a["counts"][i:j] for a, (i, j) in zip(runs, cuts)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    low, contexts = start // vocabulary, (end - 1) // vocabulary - start // vocabulary + 1
    context, word = (keys // np.uint64(vocabulary)).astype(np.int64), (keys % np.uint64(vocabulary)).astype(np.int64)
    share = (counts - DISCOUNT) / total(context)
    spent = np.bincount(context - low, share, minlength=contexts).astype(float)
    for c in {low, low + contexts - 1}:  # other ranges may hold entries of these: add up all runs
        k = m = 0
        for a in runs:
            i, j = np.searchsorted(a["keys"], np.array([c * vocabulary, (c + 1) * vocabulary], np.uint64))
            k, m = k + int(j - i), m + int(a["counts"][i:j].sum(dtype=np.int64))
        spent[c - low] = (m - DISCOUNT * k) / total(np.array([c]))[0] if k else 0.0
    weight = np.maximum(1 - spent, 1e-7)
    prob = np.log10(np.minimum(1.0, share + weight[context - low] * 10.0 ** lower(context, word)))
    pointers = np.concatenate([[0], np.cumsum(np.bincount(context - low, minlength=contexts))]).astype(np.uint64)
    arrays = {f"e.{k}": v for k, v in ef.encode(keys - np.uint64(low * vocabulary), contexts * vocabulary).items()}
    arrays |= {f"p.{k}": v for k, v in ef.encode(pointers, len(keys) + 1).items()}
    arrays["prob"], arrays["prob.scale"] = _quantised(prob)
    arrays["back"], arrays["back.scale"] = _quantised(np.log10(weight))
    arrays["count"] = counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts
    ef.write_arrays(folder, name, arrays)
    return len(keys)


Level = Callable[[Trie, int], tuple[Callable, Callable]]


def _level(rows: DataFrame, text_col: str, layout: Layout, seen: list[int], contexts: list[int], keys_of: Callable[[], Counts], with_lower: Level, least: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Count and write the next level: its ranges per shard, and the counts that were kept per shard.

    ``seen``: tokens of each shard's contexts; ``with_lower(trie, shard)``: the functions that ``_range`` takes.
    """
    level, vocabulary, shards = len(layout.entries) + 2, sum(layout.words), layout.shards
    folder, aside = layout.folder, f"{layout.folder}/runs-{level}"
    parts = [max(1, -(-n // PART_TOKENS)) for n in seen]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    size = RANGE

    def write_run(p: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
        kept = counts >= least
        keys, counts = keys[kept], counts[kept]
        if len(keys):
            ef.write_arrays(aside, str(p), {"keys": keys, "counts": counts.astype(np.uint32) if counts.max() < 1 << 32 else counts})
        s = np.searchsorted(first, p, "right") - 1
        wanted = p == first[s] and len(keys) * parts[s] > size // 2
        return len(keys), int(counts.sum()), keys[:: max(1, min(STEP, len(keys) // 64))].tobytes() if wanted else b""

    got = _built(_counted(rows, text_col, parts, keys_of), first[-1], write_run)
    jobs = []
    for s in range(shards):
        own = range(first[s], first[s + 1])
        entries = sum(got[p][0] for p in own)
        if entries:
            starts = _borders(entries, contexts[s], vocabulary, np.frombuffer(got[first[s]][2], np.uint64))
            runs = [str(p) for p in own if got[p][0]]
            jobs += [(s, r, runs, a, b) for r, (a, b) in enumerate(zip(starts, [*starts[1:], contexts[s] * vocabulary]))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(layout)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = []
            for s, r, runs, start, end in (jobs[i] for i in ids):
                files = [ef.read_arrays(aside, name) for name in runs]
                sizes.append(_range(folder, f"{level}-{s}-{r}", files, start, end, vocabulary, *with_lower(trie, s)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "n"])

    ranges: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    if jobs:
        done = rows.sparkSession.range(0, len(jobs), 1, len(jobs)).mapInArrow(merge, "id bigint, n bigint").collect()
        for i, n in sorted((r["id"], r["n"]) for r in done):
            ranges[jobs[i][0]].append((jobs[i][3], n))
        ef.remove(aside)
    return ranges, [sum(got[p][1] for p in range(first[s], first[s + 1])) for s in range(shards)]


def train(rows: DataFrame, text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, folder: str | None = None, shards: int | None = None) -> Layout:
    """Count, prune and write a model of ``order`` 1 to 3 over all rows; ``folder``: a shared one, else under the checkpoint folder."""
    folder = folder or f"{ensure_checkpoint_dir(rows.sparkSession)}/ngram-{uuid.uuid4().hex}"
    if shards is None:
        shards = 1 << max(4, (rows.count() // ROWS_PER_SHARD).bit_length())
    empty = Layout(folder, shards, [0] * shards, 0, [])
    head = Trie(empty)

    def first_keys() -> Counts:
        return lambda tokens, bounds: (head.shard_of(tokens), tokens)

    def write_first(s: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
        ef.write_arrays(folder, f"1-{s}", {"hash": keys, "count": counts.astype(np.uint32) if counts.max() < 1 << 32 else counts})
        return len(keys), int(counts.sum()), b""

    sizes = _built(_counted(rows, text_col, [1] * shards, first_keys), shards, write_first)
    seen = [m for _, m, _ in sizes]
    layout = Layout(folder, shards, [n for n, _, _ in sizes], sum(seen), [])

    def second_keys() -> Counts:
        trie = Trie(layout)

        def keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, _ = _distinct_words(trie, tokens)
            at = _inside(bounds, 1)
            left = ids[at - 1]
            shard = np.searchsorted(trie.start, left, "right") - 1
            return shard, (left - trie.start[shard]).astype(np.uint64) * np.uint64(trie.vocabulary) + ids[at].astype(np.uint64)

        return keys

    def second_lower(trie: Trie, s: int) -> tuple[Callable, Callable]:
        own = trie.first[s]["count"]
        return lambda context: own[context].astype(float), lambda context, word: trie.unigram(trie.count_of(word))

    def third_keys() -> Counts:
        trie = Trie(layout)

        def keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, _ = _distinct_words(trie, tokens)
            at = _inside(bounds, 1)
            shard, entry, _, _ = _bigrams(trie, ids, at)
            every, place = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
            every[at], place[at] = entry, shard
            # a triple seen often enough has both of its pairs kept
            at = _inside(bounds, 2)
            at = at[(every[at - 1] >= 0) & (every[at] >= 0)]
            return place[at - 1], every[at - 1].astype(np.uint64) * np.uint64(trie.vocabulary) + ids[at].astype(np.uint64)

        return keys

    def third_lower(trie: Trie, s: int) -> tuple[Callable, Callable]:
        own = trie.levels[0][s]

        def lower(context: np.ndarray, word: np.ndarray) -> np.ndarray:
            # the context's last word, then its pair with the word, which is kept
            middle, _ = own.at(context)
            both = np.stack([middle, word])
            found, back = np.unique((both[0].astype(np.uint64) << np.uint64(32)) | both[1].astype(np.uint64), return_inverse=True)
            left, right = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
            shard = np.searchsorted(trie.start, left, "right") - 1
            entry, prob, weight = trie.follow(2, shard, left - trie.start[shard], right)
            return np.where(entry >= 0, prob, weight + trie.unigram(trie.count_of(right)))[back]

        return lambda context: own.at(context)[1].astype(float), lower

    contexts = layout.words
    for keys, lower in ((second_keys, second_lower), (third_keys, third_lower))[: order - 1]:
        if not layout.tokens or layout.entries and not any(layout.entries[-1]):
            break
        ranges, seen = _level(rows, text_col, layout, seen, contexts, keys, lower, min_count)
        layout = Layout(folder, shards, layout.words, layout.tokens, [*layout.entries, ranges])
        contexts = [sum(n for _, n in x) for x in ranges]
    return layout


def score_tokens(trie: Trie, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, base log10 probability, model log10 probability) of each token."""
    ids, counts = _distinct_words(trie, tokens)
    base = trie.unigram(counts)
    logs = base.copy()
    if not trie.levels:
        return counts, base, logs
    every, place = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    at = _inside(bounds, 1)
    at = at[ids[at - 1] >= 0]
    shard, entry, prob, weight = _bigrams(trie, ids, at)
    logs[at] = np.where(entry >= 0, prob, weight + base[at])
    every[at], place[at] = entry, shard
    if len(trie.levels) > 1:
        at = _inside(bounds, 2)
        at = at[every[at - 1] >= 0]
        order = np.lexsort((every[at - 1], place[at - 1]))
        at = at[order]
        entry, prob, weight = trie.follow(3, place[at - 1], every[at - 1], ids[at])
        logs[at] = np.where(entry >= 0, prob, weight + logs[at])
    return counts, base, logs


def score(docs: DataFrame, layout: Layout, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score per row."""
    rows = docs.select(*dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(layout)
        for b in batches:
            for i, j, w in slices(b.column(text_col), WHITE):
                tokens, bounds = with_ends(w.hashes, w.first)
                counts, base, logs = score_tokens(trie, tokens, bounds)
                at = bounds[:-1]
                yield replace_columns(
                    b.slice(i, j - i), keep,
                    n_tokens=pa.array(np.diff(bounds)),
                    n_known=pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)),
                    train_tokens=pa.array(np.full(j - i, layout.tokens, np.int64)),
                    base_score=pa.array(np.add.reduceat(base, at)),
                    score=pa.array(np.add.reduceat(logs, at)),
                )

    schema = ", ".join(f"`{c}` {type_of(rows, c)}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train_and_score(docs: DataFrame, train_rows: DataFrame, keep: list[str], text_col: str = "text", **options) -> DataFrame:
    """Scores by a model of ``train_rows``. Scores are written to the checkpoint folder, then the model's files are removed."""
    layout = train(train_rows, text_col, **options)
    out = cut(score(docs, layout, keep, text_col))
    if layout.tokens:
        ef.remove(layout.folder)
    return out


__all__ = ["Layout", "Trie", "score", "score_tokens", "train", "train_and_score"]
