"""One pass over the tokens of a text with an explicit stack of open parentheses and sub-selects.

Nesting is not a window function: what a token belongs to depends on the last parenthesis opened at its depth, and on
the clause of the sub-select around it. ``fold`` walks a text once and gives every token its depth, frame, scope,
clause, arm, segment and neighbours. Texts come in Arrow batches bounded in rows and bytes; neighbours, lines and offsets are
taken for a whole batch at once, only the walk itself goes token by token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from queryscope.functions import words as K
from queryscope.plans.grammar import faults

JOIN_WORDS = frozenset(["LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "NATURAL", "SEMI", "ANTI", "JOIN"])
SET_OPS = frozenset(["UNION", "INTERSECT", "EXCEPT", "MINUS"])
FROM_LIKE = frozenset(["FROM", "JOIN", "ON", "USING", "COMMA"])
LIST_CLAUSES = frozenset(["SELECT", "GROUP", "ORDER", "SET", "VALUES", "WITH"])
AND_CLAUSES = frozenset(["WHERE", "ON", "HAVING", "QUALIFY"])
SOURCES = frozenset(["FROM", "JOIN", "COMMA", "UPDATE", "MERGE", "MERGESRC", "INTO"])
AGGREGATES = frozenset(K.AGGREGATES)
ITSELF = frozenset(["SELECT", "WHERE", "HAVING", "QUALIFY", "LIMIT", "SET", "VALUES", "RETURNING"])
STARTS = (None, ";", "EXPLAIN")


def open_kind(p1: str | None, p2: str | None, pk1: str | None, n1: str | None) -> str:
    """What an opening parenthesis opens."""
    if n1 in ("SELECT", "WITH"):
        return "select"
    if p1 == "OVER":
        return "over"
    if p1 == "FILTER":
        return "filter"
    if p1 in AGGREGATES:
        return "agg"
    return "func" if pk1 == "word" or p1 in ("LEFT", "RIGHT", "REPLACE") else "group"


def inner_kind(u: str, p2: str | None) -> str:
    """What the first token inside a parenthesis stands in."""
    if u in ("SELECT", "WITH"):
        return "select"
    if p2 in ("OVER", "FILTER"):
        return p2.lower()
    return "agg" if p2 in AGGREGATES else "other"


def clause_word(u: str, p1: str | None, n1: str | None, n2: str | None) -> str | None:
    """The clause that a token directly in a SELECT opens, if any."""
    if u in JOIN_WORDS and p1 not in JOIN_WORDS and (u == "JOIN" or n1 in JOIN_WORDS or n1 == "LATERAL"):
        return "JOIN"
    if u in ("FROM", "ON"):
        return None if p1 == "DISTINCT" else u
    if u == "USING":
        return "USING" if n1 == "(" else "MERGESRC"
    if u in ("GROUP", "ORDER"):
        return u if n1 == "BY" else None
    if u == "OFFSET":
        return None if p1 == "[" else "OFFSET"
    if u == "FETCH":
        return "LIMIT" if n1 in ("FIRST", "NEXT") else None
    if u == "WITH":
        return "WITH" if p1 in (None, ";", "(", "AS", "EXPLAIN") else None
    if u in SET_OPS:
        return None if u == "EXCEPT" and n1 == "(" and n2 != "SELECT" else "SETOP"
    if u == "INTO":
        return "INTO" if p1 in ("INSERT", "OVERWRITE", "IGNORE", "REPLACE") and n1 != "TABLE" else None
    if u == "TABLE":
        return "INTO" if p1 in ("INTO", "OVERWRITE") else None
    if u == "OVERWRITE":
        return "INTO" if p1 == "INSERT" and n1 not in ("INTO", "TABLE") else None
    if u == "INSERT":
        return "INTO" if p1 in (*STARTS, ")") and n1 not in ("INTO", "OVERWRITE", "IGNORE", "OR", "ALL", "FIRST") else None
    if u in ("UPDATE", "DELETE"):
        return u if p1 in (*STARTS, ")") else None
    if u == "MERGE":
        return "MERGE" if p1 in STARTS else None
    if u == "WHEN":
        return "MERGEWHEN" if n1 in ("MATCHED", "NOT") and n2 in ("THEN", "MATCHED", "AND", "BY") else None
    return u if u in ITSELF else None


class Scope:
    """Running facts of one SELECT (or statement)."""

    __slots__ = ("word", "clause", "setop", "n_setop", "arm", "cases", "last_and", "seg", "src_no")

    def __init__(self):
        self.word = self.setop = self.last_and = None
        self.clause = "HEAD"
        self.n_setop = self.arm = self.cases = self.seg = self.src_no = 0


#: what ``fold`` gives per token, with Arrow types
FACTS = {
    "stmt": pa.int64(), "depth": pa.int64(), "okind": pa.string(), "frame": pa.int64(), "fkind": pa.string(), "m_at": pa.int32(), "in_agg": pa.int64(),
    "in_over": pa.int64(), "in_filter": pa.int64(), "in_select": pa.int64(), "scope": pa.int64(), "direct": pa.bool_(), "ckw": pa.string(), "setop_at": pa.int32(),
    "n_setop": pa.int64(), "arm0": pa.int64(), "cases": pa.int64(), "brk": pa.bool_(), "clause": pa.string(), "seg": pa.int64(), "src_no": pa.int64(),
    "sub_where": pa.int64(), "sub_select": pa.int64(), "in_exists": pa.int64(), "rseg": pa.int64(), "up": pa.int64(),
}


def fold(u: list[str], kind: list[str]) -> list[tuple]:
    """One tuple of ``FACTS`` per token."""
    out = []
    size = len(u)
    stmt = opens = closes = sub_where = sub_select = in_exists = 0
    rseg = None
    first: dict[int, tuple] = {}  # depth -> (position, kind) of the last first token inside a parenthesis
    opened: dict[int, tuple] = {}  # depth -> (position, kind, what stands before) of the last opening parenthesis
    level = {"agg": 0, "over": 0, "filter": 0, "select": 0, "func": 0, "group": 0}
    selects: dict[int, int] = {}  # number of open sub-selects -> position of the last one's first token
    scopes: dict[int, Scope] = {}
    scope = None
    for i in range(size):
        x = u[i]
        p1 = u[i - 1] if i else None
        p2 = u[i - 2] if i > 1 else None
        n1 = u[i + 1] if i + 1 < size else None
        okind = m = None
        if x == "(":
            okind = open_kind(p1, p2, kind[i - 1] if i else None, n1)
        elif x == ")":
            closes += 1
        depth = opens - closes
        root = -(stmt + 1)
        inner = p1 == "(" and x != ")"
        if inner:
            first[depth] = (i + 1, inner_kind(x, p2))
        frame, fkind = (root, "root") if depth <= 0 else first.get(depth, (None, None))
        if x == ")":
            m = opened.get(depth)
            if m:
                level[m[1]] -= 1
        in_select = level["select"]
        up = None
        if inner and x in ("SELECT", "WITH"):
            selects[in_select] = i + 1
            up = scope  # that of the parenthesis
        scope = root if in_select <= 0 else selects.get(in_select)
        direct = frame == scope
        s = scopes.get(scope)
        if s is None:
            s = scopes[scope] = Scope()
        word = None
        setop, last_and = s.setop, s.last_and
        if direct:
            word = clause_word(x, p1, n1, u[i + 2] if i + 2 < size else None)
            if x == "CASE":
                s.cases += 1
            elif x == "END":
                s.cases -= 1
            elif x in ("BETWEEN", "AND"):
                s.last_and = x
        if word:
            s.word = word
            if word == "SETOP":
                s.n_setop += 1
                s.setop = i + 1
            elif word == "SELECT":
                s.arm += 1
        item = False
        if direct:
            if x == ",":
                if s.word in FROM_LIKE:
                    word = "COMMA"
                item = s.word in LIST_CLAUSES
            elif x == "AND":
                item = s.word in AND_CLAUSES and s.cases == 0 and last_and != "BETWEEN"
        brk = word is not None or item
        if word:
            s.clause = word
            if word in SOURCES:
                s.src_no += 1
        s.seg += brk
        clause = s.clause
        if m and m[1] == "select":
            sub_where -= clause == "WHERE"
            sub_select -= clause == "SELECT"
            in_exists -= m[2] == "EXISTS"
        if scope is not None and scope < 0:
            rseg = s.seg
        out.append((
            stmt, depth, okind, frame, fkind, m[0] if m else None, level["agg"], level["over"], level["filter"], in_select, scope, direct, word, setop,
            s.n_setop, s.arm, s.cases, brk, clause, s.seg, s.src_no, sub_where, sub_select, in_exists, rseg, up,
        ))
        if x == "(":
            opened[depth] = (i + 1, okind, p1)
            level[okind] += 1
            opens += 1
            if okind == "select":
                sub_where += clause == "WHERE"
                sub_select += clause == "SELECT"
                in_exists += p1 == "EXISTS"
        elif x == ";":
            stmt += 1
    return out


#: neighbours: output name -> (column, steps back)
NEIGHBOURS = {
    **{f"p{k}": ("u", k) for k in range(1, 6)}, "n1": ("u", -1), "n2": ("u", -2), "pk1": ("kind", 1), "nk1": ("kind", -1), "pt1": ("text", 1), "nt1": ("text", -1),
    "name2": ("name", 2), "name4": ("name", 4),
}

TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
#: the opening parenthesis of a closing one, and the set operation before the last: structs looked up at the places that the walk gives
PAIRS = {"m": ("m_at", ["okind", "u"]), "prev_setop": ("setop_at", ["u"])}
#: facts that the walk itself gives
GIVEN = {"text": "string", "u": "string", "kind": "string", "name": "string", "line": "int", "at": "int", "fault": "string", **{n: TYPES[t] for n, t in FACTS.items()}}
#: everything that can be asked for
COLUMNS = [*(k for k in GIVEN if k not in ("m_at", "setop_at")), "pos", *NEIGHBOURS, *PAIRS]


def given_for(wanted: list[str]) -> list[str]:
    """The facts of the walk that the ``wanted`` columns are made of."""
    need = set()
    for k in wanted:
        if k in NEIGHBOURS:
            need.add(NEIGHBOURS[k][0])
        elif k in PAIRS:
            need.update([PAIRS[k][0], *PAIRS[k][1]])
        elif k != "pos":
            need.add(k)
    return [k for k in GIVEN if k in need] or ["u"]


def _before(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of the earlier values of the same text."""
    total = np.cumsum(x) - x
    return total - np.repeat(total[borders[:-1]], np.diff(borders)) if len(x) else total


def walked(tokens: pa.ListArray, dialect: pa.Array, wanted: list[str]) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(per fact of ``GIVEN`` the values of all tokens, where each text's begin); tokens are structs (text, u, kind, name, breaks, inner, lead, width), comments included."""
    flat = tokens.flatten()
    sizes = np.diff(tokens.offsets.to_numpy())
    borders = np.r_[0, np.cumsum(sizes)]
    number = lambda name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat.field("kind"), "comment").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    keep = np.flatnonzero(real)
    filled = np.flatnonzero(sizes)  # a text without tokens has no border of its own
    own = np.r_[borders[filled], len(flat)]
    text_no = np.repeat(np.arange(len(sizes)), sizes)[keep]
    sizes = np.bincount(text_no, minlength=len(sizes))
    borders = np.r_[0, np.cumsum(sizes)]
    taken = pa.array(keep)
    columns = {k: flat.field(k).take(taken) for k in ("text", "u", "kind", "name") if k in wanted}
    if "line" in wanted:
        breaks = number("breaks")
        columns["line"] = pa.array((_before(breaks, own) + breaks - number("inner") + 1)[keep].astype(np.int32))
    if "at" in wanted:
        lead = number("lead")
        columns["at"] = pa.array((_before(lead + number("width"), own) + lead)[keep].astype(np.int32))
    asked = [(k, i) for i, k in enumerate(FACTS) if k in wanted]
    if asked or "fault" in wanted:
        plain = lambda column: column.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        u, kind, names = plain(flat.field("u").take(taken)), plain(flat.field("kind").take(taken)), plain(dialect)
        facts: dict[str, list] = {k: [] for k, _ in asked}
        fault: list[str | None] = []
        for k, (s, e) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
            if asked and e > s:
                by_fact = list(zip(*fold(u[s:e], kind[s:e])))  # the tuples of a text are gone before the next one
                for name, i in asked:
                    facts[name].extend(by_fact[i])
            if "fault" in wanted:
                fault.extend(faults(u[s:e], kind[s:e], names[k]))
        columns |= {k: pa.array(v, FACTS[k]) for k, v in facts.items()}
        columns["fault"] = pa.array(fault, pa.string())
    return columns, borders


def facts_of(tokens: pa.ListArray, dialect: pa.Array, wanted: list[str]) -> pa.StructArray:
    """Per text and fact of ``GIVEN`` the array of its tokens' values."""
    columns, borders = walked(tokens, dialect, wanted)
    offsets = pa.array(borders, pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, columns[k]) for k in wanted], wanted)
