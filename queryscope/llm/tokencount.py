"""Exact token counts at every prefix of a text, by dynamic programming over a word-end BPE vocabulary.

The encoding of a prefix is the encoding of a shorter prefix and one last token, and that last token is the only
vocabulary entry that ends there and forms a stable pair with the token before it. So one left-to-right pass over a word
gives the last token and the count at each of its prefixes, open (more letters follow) and closed (the word ends). The
count at a prefix of a text is the sum over its complete words plus the closed count inside the last one: truncation and
budget questions are answered from these numbers without encoding again.

The tokenizer's own normaliser and pre-tokenizer cut texts into words; no encoder of the library is called. Words are
remembered per worker up to ``MEMORY`` entries.

Defined cases: null and empty texts have no tokens; the tokenizer's special strings inside a text count as one token;
repeated rows are counted each; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import replace_columns, texts_of, type_of

END = "</w>"
#: words remembered by a worker
MEMORY = 1_000_000
_loaded: dict[str, "PrefixCounter"] = {}
#: white space to Python, but not to the tokenizers library
_ODD = re.compile("[\x1c-\x1f]")

#: chunks that every step of the normaliser leaves as they are but for lower case: printable ASCII and Latin-1 letters
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: the pre-tokenizer's pattern for such chunks in lower case
_SIMPLE_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: that pattern in the file; the short cut holds for no other
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """Byte -> the code point that stands for it: printable Latin-1 for itself, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def simple_cut(spec: dict) -> bool:
    """Whether the short cut for simple chunks holds for a tokenizers file."""
    specials = [t["content"] for t in spec["added_tokens"]]
    return '"Regex": ' + json.dumps(_PATTERN) in json.dumps(spec["pre_tokenizer"]) and all(t.startswith("<|") for t in specials)


def chunks_of(text: str) -> list[str]:
    """The text between white space as the tokenizer sees it."""
    return re.findall("[^ \\t-\\r]+", text) if _ODD.search(text) else text.split()


class PrefixCounter:
    """Counts for one tokenizers file with a byte-level BPE that marks word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        lib = Tokenizer.from_str(json.dumps(spec))
        self.normal, self.words = lib.normalizer, lib.pre_tokenizer
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.plain_specials = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or not self.plain_specials:
            raise ValueError("a BPE vocabulary with word ends is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {}
        for k, pair in enumerate(merges):
            self.rank.setdefault(pair, k)
        self.parts: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        for (a, b), k in self.rank.items():
            if a + b not in self.born:
                self.parts[a + b], self.born[a + b] = (a, b), k
        known = set(model["vocab"]) - set(specials)
        self.pairs: dict[tuple[str, str], bool] = {}
        # tokens by surface; only those that the merges really build from their own letters
        self.open, self.closed = set(), set()
        self.longest = 0
        for t in sorted(known, key=len):
            if t in self.parts:
                a, b = self.parts[t]
                if not (a in known and b in known and self._stable(a, b, self.born[t])):
                    continue
            elif len(t.removesuffix(END)) > 1:
                continue
            (self.closed if t.endswith(END) else self.open).add(t)
            self.longest = max(self.longest, len(t.removesuffix(END)))
        self.short_cut = simple_cut(spec)
        #: last tokens and counts at the open prefixes of the word looked at last: words come sorted, so most of it holds again
        self.opened: tuple[list[str], list[int], str] = ([""], [0], "")
        self.memory: dict[str, int] = {}
        self.known_words: dict[str, int] = {}

    def _spine(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """(symbol, merge that makes it, merge that ends it) at one edge of a token, from the whole to a letter."""
        out, until = [], float("inf")
        while True:
            made = self.born.get(token, -1)
            out.append((token, made, until))
            if token not in self.parts:
                return out
            token, until = self.parts[token][side], made

    def _stable(self, a: str, b: str, before: float = float("inf")) -> bool:
        """Whether ``a`` followed by ``b`` stays two tokens under all merges ranked before ``before``.

        The edge symbols of both tokens exist at the same time for some span of ranks; a merge of two edge symbols inside
        their common span would join them. At equal rank the left place is merged first.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        for x, x_from, x_to in left:
            for y, y_from, y_to in right:
                k = self.rank.get((x, y))
                if k is None or k >= before or k < x_from or k < y_from:
                    continue
                # x is used up at rank x_to by a merge further left, which wins a tie; y by one further right, which loses it
                if k < x_to and k <= y_to:
                    return False
        return True

    def _fits(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self._stable(a, b)
        return found

    def _last(self, word: str, k: int, last: list[str], tokens: set[str], mark: str) -> int:
        """Start of the last token of ``word[:k]``."""
        pairs = self.pairs
        for s in range(max(0, k - self.longest), k):
            t = word[s:k] + mark
            if t in tokens:
                if not s:
                    return s
                a = last[s]
                ok = pairs.get((a, t))
                if ok is None:
                    ok = self._fits(a, t)
                if ok:
                    return s
        raise ValueError(f"no encoding for {word[:k]!r}")

    def prefixes(self, word: str) -> list[int]:
        """Tokens of the word cut after each of its letters (closed), from 0 letters on."""
        last, count, closed = [""], [0], [0]
        for k in range(1, len(word) + 1):
            s = self._last(word, k, last, self.closed, END)
            closed.append(count[s] + 1)
            s = self._last(word, k, last, self.open, "")
            last.append(word[s:k])
            count.append(count[s] + 1)
        return closed

    def word(self, word: str) -> int:
        """Tokens of a whole word; the closed table is only needed at its end."""
        n = self.known_words.get(word)
        if n is None:
            last, count, before = self.opened
            same = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                same += 1
            same = min(same, len(word) - 1, len(last) - 1)
            del last[same + 1 :], count[same + 1 :]
            tokens, pairs = self.open, self.pairs
            for k in range(same + 1, len(word)):
                for s in range(k - self.longest if k > self.longest else 0, k):
                    t = word[s:k]
                    if t in tokens and (not s or (pairs[last[s], t] if (last[s], t) in pairs else self._fits(last[s], t))):
                        break
                last.append(t)
                count.append(count[s] + 1)
            self.opened = last, count, word
            n = count[self._last(word, len(word), last, self.closed, END)] + 1
            if len(self.known_words) >= MEMORY:
                self.known_words.clear()
            self.known_words[word] = n
        return n

    def pieces(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """(word in byte letters, place in the normalised text) as the tokenizer cuts it; specials are not looked for."""
        return self.words.pre_tokenize_str(self.normal.normalize_str(text))

    def _learn(self, chunks: list[str]) -> None:
        """Remember counts of chunks without white space. Those beyond the short cut are cut together, a space between them."""
        memory, word, rest = self.memory, self.word, []
        for c in chunks:
            if self.short_cut and _SIMPLE.fullmatch(c) and not (self.special and "<|" in c):
                low = c.lower()
                memory[c] = sum(map(word, _SIMPLE_WORDS.findall(low))) if low.isascii() else sum(
                    word(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)) for w in _SIMPLE_WORDS.findall(low)
                )
            elif self.special and self.special.search(c):
                parts = self.special.split(c)
                memory[c] = sum(1 if k % 2 else sum(word(w) for w, _ in self.pieces(p)) for k, p in enumerate(parts) if p)
            else:
                rest.append(c)
        plain = list(map(self.normal.normalize_str, rest))
        ends, at = [], 0
        for c, p in zip(rest, plain):
            memory[c] = 0
            at += len(p) + 1
            ends.append(at)
        k, end = -1, 0
        for piece, (_, stop) in self.words.pre_tokenize_str(" ".join(plain)) if rest else ():
            while stop >= end:
                k += 1
                end = ends[k]
            memory[rest[k]] += word(piece)

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the count at their last prefix."""
        known, out, late = self.memory.get, [], []
        for i, t in enumerate(texts):
            found = list(map(known, chunks_of(t)))
            if None in found:
                late.append(i)
                out.append(0)
            else:
                out.append(sum(found))
        for k in range(0, len(late), 256):
            self._total_unknown(texts, late[k : k + 256], out)
        return out

    def _total_unknown(self, texts: list[str], places: list[int], out: list[int]) -> None:
        cut = [chunks_of(texts[i]) for i in places]
        new = {c for chunks in cut for c in chunks if c not in self.memory}
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = {c for chunks in cut for c in chunks}
        if new:
            self._learn(sorted(new))
        for i, chunks in zip(places, cut):
            out[i] = sum(map(self.memory.__getitem__, chunks))

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def at(self, text: str, length: int) -> int:
        """Tokens of ``text[:length]``: complete chunks from memory, then the open chunk."""
        return self.total(text[:length])

    def prefix_counts(self, text: str) -> list[int]:
        """Token count at every prefix ``text[:i]``, i from 0 to the length of the text."""
        out, done, i = [0], 0, 0
        for m in re.finditer(r"[^ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text):
            out += [done] * (m.start() - i)
            done_here = self._chunk_prefixes(m.group())
            out += [done + n for n in done_here[1:]]
            done += done_here[-1]
            i = m.end()
        return out + [done] * (len(text) - i)

    def _chunk_prefixes(self, chunk: str) -> list[int]:
        pieces = self.pieces(chunk) if chunk.isascii() and not (self.special and self.special.search(chunk)) else None
        if pieces is None or "'" in chunk or sum(len(w) for w, _ in pieces) != len(chunk):
            # letters that the normaliser joins, special strings and contractions: each prefix is cut anew
            return [self.total(chunk[:k]) for k in range(len(chunk) + 1)]
        out, done = [0], 0
        for w, _ in pieces:
            closed = self.prefixes(w)
            out += [done + n for n in closed[1:]]
            done += closed[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Longest prefix (in characters) of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


def counter(path: str) -> PrefixCounter:
    """One counter per worker and file."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = counter(path)
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(text_col)), 0).cast(pa.int64())
            yield replace_columns(b, [id_col], n_tokens=pa.array(dp.totals(texts_of(b, text_col)), pa.int64()), n_bytes=size)

    out = rows.mapInArrow(run, f"`{id_col}` {type_of(rows, id_col)}, n_tokens bigint, n_bytes bigint")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``counts``, the token count at every prefix (one entry per character and one for none)."""
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = counter(path)
        for b in batches:
            yield replace_columns(b, [id_col], counts=pa.array([dp.prefix_counts(t) for t in texts_of(b, text_col)], pa.list_(pa.int32())))

    return rows.mapInArrow(run, f"`{id_col}` {type_of(rows, id_col)}, counts array<int>")
