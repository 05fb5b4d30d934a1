"""Best-fit packing of documents into token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens. How pieces are combined depends on their lengths alone, so the
search works on the histogram of lengths (at most ``capacity`` entries, whatever the corpus): it takes the largest length
left, draws undominated fillings, and branches over them in order of waste. A branch whose waste exceeds what
would still beat the incumbent is cut; the incumbent is best-fit decreasing at first, and any better packing found. A
filling is used for as many sequences as the stock of its lengths allows. A dive ends at a whole packing or where its branch
is cut, however many nodes that takes; the search ends at the lower bound, when no filling is left to try, or after the
first dive and ``BACKTRACKS`` more; then the incumbent stands.

Limits of the search: a node tries at most ``WIDTH`` fillings, each extended in one way only, and from 48 lengths on triples
start at every ``lengths // 24``-th length only. So an exhausted search proves nothing about fillings it did not draw.

The result is a list of patterns with multiplicities. Pieces are numbered per length on Spark, and (length, number) leads
to sequence and offset by one lookup in the pattern table, whose size is bounded by ``capacity``.

Defined cases: null and empty texts have the end token only; longer documents are cut into full pieces and a rest;
repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import Recent, lean, numbered_locally, replace_columns, texts_of, type_of, with_rank
from queryscope.llm.tokencount import _SIMPLE, _SIMPLE_WORDS, END, chunks_of, simple_cut

CAPACITY = 4096
END_ID = 1
#: dives after the first one; each goes on from the last node that has another filling
BACKTRACKS = 3_000
#: chunks, and words, in each generation of a worker's memory
MEMORY = 250_000
#: texts whose words the short cut finds without looking at chunks, and those words in lower case (``tokencount._SIMPLE`` with white space)
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PLAIN_WORDS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\t-\r ]+")
#: fillings tried at one node
WIDTH = 4

Pattern = tuple[dict[int, int], int]  # length -> uses, number of sequences


def best_fit(stock: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal open sequences are handled as one group."""
    room: dict[int, list[list]] = {}  # room left -> [[uses, number], ...]
    for length in sorted(stock, reverse=True):
        left = stock[length]
        while left:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                each = capacity // length
                uses, number = {}, left
            else:
                each = fit // length
                uses, number = room[fit].pop()
            base = capacity if fit is None else fit
            if left >= each:
                take = min(number, left // each) if fit is not None else left // each
                if fit is not None and number > take:
                    room[fit].append([uses, number - take])
                placed = each
            else:
                take, placed = 1, left
                if fit is not None and number > 1:
                    room[fit].append([uses, number - 1])
            left -= take * placed
            room.setdefault(base - placed * length, []).append([{**uses, length: uses.get(length, 0) + placed}, take])
    return [(u, n) for r in sorted(room) for u, n in room[r]]


def lower_bound(stock: dict[int, int], capacity: int) -> int:
    """Sequences that are needed at least: by volume, and by pieces that leave room for too few others."""
    total = sum(k * n for k, n in stock.items())
    best = -(-total // capacity)
    lengths = sorted(stock)
    count = np.array([stock[k] for k in lengths], np.int64)
    size = np.array(lengths, np.int64)
    for k in [x for x in lengths if 2 * x <= capacity][:: max(1, len(lengths) // 200)] + [0]:
        big = size > capacity - k
        half = (size > capacity // 2) & ~big
        small = (size >= k) & (size <= capacity // 2)
        rooms = count[half].sum() * capacity - (count[half] * size[half]).sum()
        more = -(-int((count[small] * size[small]).sum() - rooms) // capacity)
        best = max(best, int(count[big].sum() + count[half].sum()) + max(0, more))
    return best


def _few(stock: np.ndarray, room: int, width: int) -> list[list[int]]:
    """Fillings of ``room`` with one, two or three pieces: the largest piece that fits, and pairs and triples that waste less."""
    have = np.flatnonzero(stock[1 : room + 1]) + 1
    if not len(have):
        return []
    best = int(have[-1])
    if best == room:
        return [[best]]
    limit = np.zeros(room + 1, np.int64)  # largest length in stock up to each size
    limit[have] = have
    limit = np.maximum.accumulate(limit)

    def partner(a: np.ndarray, space: np.ndarray) -> np.ndarray:
        b = limit[space]
        return np.where((b == a) & (stock[a] < 2), limit[np.maximum(b - 1, 0)], b)

    a = have[::-1]
    b = partner(a, room - a)
    ok = (b > 0) & (b <= a)
    a_ok, b_ok = a[ok], b[ok]
    order = np.argsort(-(a_ok + b_ok), kind="stable")[:width]
    pairs = [[int(x), int(y)] for x, y in zip(a_ok[order], b_ok[order])]
    if pairs and sum(pairs[0]) == room:
        return [p for p in pairs if sum(p) == room]
    triples = []
    for x in map(int, a[:: max(1, len(a) // 24)]):
        y = a[(a <= x) & (a < room - x) & ((a != x) | (stock[a] > 1))]
        if len(y):
            z = limit[room - x - y]
            for other in (x, y):
                z = np.where((z == other) & (stock[z] < 1 + (z == x) + (z == y)), limit[np.maximum(z - 1, 0)], z)
            total = np.where((z > 0) & (z <= y), x + y + z, 0)
            k = int(np.argmax(total))
            if total[k]:
                triples.append([x, int(y[k]), int(z[k])])
                if total[k] == room:
                    break
    return sorted([[best], *pairs, *triples], key=sum, reverse=True)[:width]


def fillings(stock: np.ndarray, room: int, width: int = WIDTH) -> list[list[int]]:
    """Undominated fillings of ``room``, least waste first.

    A filling that leaves room for a further piece is dominated by the one that takes it, so each is extended until
    nothing fits. Where many small pieces are needed, the largest that fits comes first.
    """
    found = []
    for few in _few(stock, room, width) or [[]]:
        rest = room - sum(few)
        if few and rest:
            left = stock.copy()
            np.subtract.at(left, few, 1)
            few = few + fillings(left, rest, 1)[0]
        found.append((room - sum(few), few))
    return [f for _, f in sorted(found, key=lambda x: x[0])]


def complete(stock: dict[int, int], capacity: int, backtracks: int = BACKTRACKS) -> list[Pattern]:
    """Patterns of a packing: bin completion with the best-fit packing as first incumbent."""
    best = best_fit(stock, capacity)
    number = sum(n for _, n in best)
    bound = lower_bound(stock, capacity)
    total = sum(k * n for k, n in stock.items())
    now = np.zeros(capacity + 1, np.int64)
    for k, n in stock.items():
        now[k] = n
    # depth first, on one stock: the patterns of the branch, and at each of its nodes the fillings not tried yet
    chosen: list[Pattern] = []
    untried: list[list[list[int]]] = []
    waste = 0

    def use(pattern: Pattern, sign: int) -> int:
        uses, times = pattern
        for k, n in uses.items():
            now[k] -= sign * n * times
        return sign * times * (capacity - sum(k * n for k, n in uses.items()))

    while number > bound:
        have = np.flatnonzero(now)
        if len(have) and waste <= (number - 1) * capacity - total:
            largest = int(have[-1])
            now[largest] -= 1
            untried.append([[largest, *f] for f in fillings(now, capacity - largest)])
            now[largest] += 1
        else:
            used = sum(n for _, n in chosen)
            if not len(have) and used < number:
                best, number = chosen.copy(), used
            if not backtracks:
                break
            backtracks -= 1
            while untried:
                waste += use(chosen.pop(), -1)
                if untried[-1]:
                    break
                untried.pop()
            if not untried:
                break
        uses: dict[int, int] = {}
        for k in untried[-1].pop(0):
            uses[k] = uses.get(k, 0) + 1
        chosen.append((uses, min(int(now[k]) // n for k, n in uses.items())))
        waste += use(chosen[-1], 1)
    return best


class PlaceTable:
    """(length, number of the piece among those of its length) -> sequence and offset."""

    def __init__(self, patterns: list[Pattern]):
        rows, taken, sequence = [], {}, 0
        for uses, times in patterns:
            offset = 0
            for length in sorted(uses, reverse=True):
                start = taken.get(length, 0)
                rows.append((length, start, sequence, uses[length], offset))
                taken[length] = start + uses[length] * times
                offset += length * uses[length]
            sequence += times
        rows.sort()
        self.length, self.start, self.sequence, self.uses, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = (self.length << 46) + self.start

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 46) + number, "right") - 1
        within = number - self.start[k]
        return self.sequence[k] + within // self.uses[k], self.offset[k] + within % self.uses[k] * length


class Encoder:
    """Ids of whole texts from a tokenizers file; ids of chunks and words are remembered as bytes."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.end = Tokenizer.from_file(path), np.uint32(end).tobytes()
        names = self.lib.get_vocab(with_added_tokens=False)
        #: whether an id ends a word
        self.ends = np.zeros(max(names.values(), default=0) + 1, bool)
        self.ends[[i for t, i in names.items() if t.endswith(END)]] = True
        self.short_cut = simple_cut(json.load(open(path, encoding="utf-8")))
        self.chunks, self.words = Recent(MEMORY), Recent(MEMORY)

    def _words(self, new: list[str]) -> None:
        """Ids of new words: many are encoded as one text, whose ids are parted after each id that ends a word."""
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            ids = np.array(self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                data, at = ids.astype("<u4").tobytes(), 0
                for w, e in zip(part, (4 * stops).tolist()):
                    self.words.now[w] = data[at:e]
                    at = e
            else:
                self._whole(part, self.words.now)

    def _whole(self, new: list[str], kept: dict[str, bytes]) -> None:
        for k in range(0, len(new), 1024):
            part = new[k : k + 1024]
            for c, e in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False)):
                kept[c] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        simple = {c: _SIMPLE_WORDS.findall(c.lower()) for c in new if self.short_cut and "<|" not in c and _SIMPLE.fullmatch(c)}
        self._words(self.words.unknown(set().union(*simple.values())))
        self._whole([c for c in new if c not in simple], self.chunks.now)
        words, chunks = self.words.now, self.chunks.now
        for c, ws in simple.items():
            chunks[c] = words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))

    def rest(self) -> None:
        """Give back most of the memory between tasks, since other operators may use the worker next; known words stay."""
        self.chunks = Recent(MEMORY)
        self.words.old = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        out: list[bytes] = []
        for k in range(0, len(texts), 128):
            part = texts[k : k + 128]
            plain = [self.short_cut and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in part]
            # plain texts are words at once; others go chunk by chunk
            cut = [_PLAIN_WORDS.findall(t.lower()) if p else chunks_of(t) for t, p in zip(part, plain)]
            new = self.chunks.unknown(set().union(*(c for c, p in zip(cut, plain) if not p)))
            if new:
                self._learn(new)
            new = self.words.unknown(set().union(*(c for c, p in zip(cut, plain) if p)))
            if new:
                self._words(new)
            known = (self.chunks.now.__getitem__, self.words.now.__getitem__)
            out += [b"".join(map(known[p], c)) + self.end for c, p in zip(cut, plain)]
        return out


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """Per piece: ``keep`` columns, piece, start, length and ids (binary, little-endian unsigned 32-bit)."""
    rows = docs.select(*dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path, end)
        for b in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, data in enumerate(_encoders[path].encode(texts_of(b, text_col))):
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            own = b.take(pa.array(row, pa.int64()))
            yield replace_columns(
                own, keep, piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids=pa.array(ids, pa.binary())
            )
        if path in _encoders:
            _encoders[path].rest()

    schema = ", ".join(f"`{c}` {type_of(rows, c)}" for c in keep)
    return rows.mapInArrow(lean(run), f"{schema}, piece int, start bigint, length bigint, ids binary")


def pack(cut_up: DataFrame, capacity: int = CAPACITY, backtracks: int = BACKTRACKS) -> DataFrame:
    """Rows with a column ``length`` (1 to ``capacity``), plus sequence_id and offset."""
    rows = numbered_locally(cut_up, "length")
    stock = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranked = with_rank(rows, "length", "_rank")
    names = cut_up.columns
    sent = cut_up.sparkSession.sparkContext.broadcast(PlaceTable(complete(stock, capacity, backtracks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, o = sent.value.place(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield replace_columns(b, names, sequence_id=pa.array(s), offset=pa.array(o))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema.fields)
    return ranked.mapInArrow(lean(run), f"{schema}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences of pieces that still carry ids; a group holds ``capacity`` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return grouped.select("sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("ids"))
