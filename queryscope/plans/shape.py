"""Segments, statements and printed forms of whole texts, taken from the walk a batch at a time.

The facts of ``plans.tokens`` are column expressions over token rows; the same facts are made here from arrays over all tokens of an
Arrow batch, grouped inside their text. So a text stays one row: no token is exploded, shuffled or sorted. Words are compared by
their code in the batch's dictionary, groups are runs of one stable sort, and lists are slices of flat columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from queryscope.functions import words as K
from queryscope.plans.fold import FACTS, walked

JOIN_WORDS = ["LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "NATURAL", "SEMI", "ANTI", "JOIN"]
JOIN_SIDES = [j.lower() for j in JOIN_WORDS if j != "JOIN"]
EXPR_CLAUSES = ["SELECT", "WHERE", "ON", "GROUP", "HAVING", "QUALIFY", "ORDER", "SET", "LIMIT", "VALUES"]
SOURCE_CLAUSES = ["FROM", "JOIN", "COMMA", "UPDATE", "MERGE", "MERGESRC"]
AND_CLAUSES = ["WHERE", "ON", "HAVING", "QUALIFY"]
HEADS = ["FROM", "JOIN", ",", "UPDATE", "INTO", "INSERT", "OVERWRITE", "TABLE", "MERGE", "USING", "LATERAL", "ONLY"]
OPERATORS = ["OR", "IS", "IN", "LIKE", "ILIKE", "BETWEEN", "EXISTS", "=", "<>", "!=", "<", ">", "<=", ">="]
_DAY = re.compile(r"^.\d{4}-\d{2}-\d{2}.$", re.ASCII)

INT, LONG, STR, BOOL = pa.int32(), pa.int64(), pa.string(), pa.bool_()


class Words:
    """A string column as codes: set tests by table, neighbours by place; a place outside its text holds nothing."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        self.known = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False) if not coded.indices.null_count else pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        self.codes = codes.astype(np.int64)
        self._tables: dict[tuple, np.ndarray] = {}

    def table(self, words: Iterable[str | None]) -> np.ndarray:
        """Per code whether it is one of ``words``; the last entry, for nothing, is true if None is one of them."""
        key = tuple(words)
        if key not in self._tables:
            among = frozenset(key)
            self._tables[key] = np.array([w in among for w in self.known] + [None in among])
        return self._tables[key]


class Tokens:
    """All tokens of a batch of texts but comments, with their facts as arrays."""

    def __init__(self, tokens: pa.ListArray, dialect: pa.Array):
        columns, borders = walked(tokens, dialect, READ)
        self.columns, self.borders, self.texts = columns, borders, len(borders) - 1
        self.size = int(borders[-1])
        self.text_no = np.repeat(np.arange(self.texts), np.diff(borders))
        self.first = borders[:-1][self.text_no] if self.size else np.zeros(0, np.int64)
        self.last = borders[1:][self.text_no] if self.size else np.zeros(0, np.int64)
        self.place = np.arange(self.size)
        self.pos = self.place - self.first + 1
        self._words: dict[str, Words] = {}
        self._codes: dict[tuple[str, int], np.ndarray] = {}
        self._numbers: dict[str, np.ndarray] = {}
        self.dialect = dialect

    def words(self, name: str) -> Words:
        if name not in self._words:
            self._words[name] = Words(self.columns[name])
        return self._words[name]

    def place_of(self, places: np.ndarray) -> np.ndarray:
        """The given places, or -1 where they lie outside their text."""
        return np.where((places >= self.first) & (places < self.last), places, -1)

    def codes(self, name: str, back: int = 0) -> np.ndarray:
        key = (name, back)
        if key not in self._codes:
            own = self.words(name).codes
            self._codes[key] = own if not back else self.codes_at(name, self.place_of(self.place - back))
        return self._codes[key]

    def codes_at(self, name: str, places: np.ndarray) -> np.ndarray:
        own = self.words(name).codes
        return np.where(places >= 0, own[places], -1) if self.size else np.zeros(0, np.int64)

    def among(self, words: Iterable[str | None], back: int = 0, name: str = "u") -> np.ndarray:
        """Is the token ``back`` steps before one of ``words``? None: there is no such token."""
        return self.words(name).table(words)[self.codes(name, back)]

    def is_(self, word: str, back: int = 0, name: str = "u") -> np.ndarray:
        return self.among((word,), back, name)

    def there(self, name: str, back: int = 0) -> np.ndarray:
        """Is there a value?"""
        return self.codes(name, back) >= 0

    def number(self, name: str) -> np.ndarray:
        """A fact as numbers or booleans; nothing counts as -1 or false."""
        if name not in self._numbers:
            column = self.columns[name]
            if column.null_count:
                column = pc.fill_null(column, False if column.type == BOOL else -1)
            self._numbers[name] = column.to_numpy(zero_copy_only=False)
        return self._numbers[name]

    def in_dialects(self, names: Iterable[str]) -> np.ndarray:
        own = Words(self.dialect)
        return own.table(names)[own.codes][self.text_no]

    def strings(self, name: str, places: np.ndarray) -> pa.Array:
        """The values at the given places; -1 gives null."""
        return self.columns[name].take(pa.array(places, mask=places < 0))


#: facts of the walk that segments and statements read
READ = ["text", "u", "kind", "name", "line", "at", "fault", *(k for k in FACTS if k != "in_select")]


def scope_facts(t: Tokens) -> dict[str, np.ndarray]:
    """Which tokens are sources, aliases, columns, calls and parts of the expression of their segment (see ``tokens.scoped_tokens``)."""
    u, clause = t.among, lambda *words: t.among(words, 0, "clause")
    direct, named = t.number("direct"), t.there("name")
    f = {}
    f["arm"] = np.where((t.number("n_setop") > 0) & clause("ORDER", "LIMIT", "OFFSET"), 0, t.number("arm0"))
    f["in_where"] = clause("WHERE") | (t.number("sub_where") > 0)
    dotted = t.is_(".", 1)
    three = dotted & t.is_(".", 3)
    last_part = named & ~t.is_(".", -1)
    calls = t.is_("(", -1)
    valueish = t.among(("word", "quoted", "num", "str"), 1, "kind") | u((")", "]", "END"), 1)
    in_src = direct & clause(*SOURCE_CLAUSES, "INTO")
    step = np.where(~dotted, 1, np.where(~t.is_(".", 3), 3, 5))
    start = t.codes_at("u", t.place_of(t.place - step))
    f["start"] = start
    word_at = lambda codes, *words: t.words("u").table(words)[codes]
    is_src = last_part & in_src & word_at(start, *HEADS)
    spot = last_part & ~dotted & ~calls & (t.is_("AS", 1) | valueish)
    f["is_src"] = is_src
    f["is_tab"] = is_src & (~calls | clause("INTO"))
    f["is_salias"] = spot & in_src & ~is_src & ~clause("INTO")
    f["is_ialias"] = spot & direct & clause("SELECT")
    noise = (
        u(("AS", "::", "NULLS"), 1) | (u(K.TYPES) & t.is_("str", -1, "kind")) | t.is_("=>", -1)
        | (u(K.DATE_PARTS) & (t.is_("FROM", -1) | t.among(("num", "str"), 1, "kind"))) | (~dotted & valueish)
    )
    zone = clause(*EXPR_CLAUSES) | (clause("FROM", "JOIN", "COMMA") & ~direct)
    every = t.is_("*")
    f["qual_at"] = np.where(dotted & (named | every), t.place_of(t.place - 2), -1)
    f["db_at"] = np.where(three & named, t.place_of(t.place - 4), -1)
    f["is_col"] = zone & ((last_part & ~calls & ~f["is_ialias"] & ~noise) | (every & dotted & t.there("name", 2)))
    f["is_fn"] = (named | u(("LEFT", "RIGHT", "REPLACE"))) & calls & ~is_src
    after = lambda *words: u(words, 1)
    f["core"] = ~(
        t.there("ckw") | (t.number("brk") & u((",", "AND"))) | f["is_ialias"] | f["is_salias"] | t.is_(";")
        | (direct & (
            (t.is_("BY") & after("GROUP", "ORDER")) | (u(("DISTINCT", "ALL")) & after("SELECT"))
            | (t.is_("TOP") & after("SELECT", "DISTINCT") & t.is_("num", -1, "kind")) | (t.is_("num", 0, "kind") & after("TOP"))
            | (t.is_("AS") & clause("SELECT", "FROM", "JOIN", "COMMA", "UPDATE", "MERGE", "MERGESRC"))
            | (clause("JOIN") & u(JOIN_WORDS)) | (clause("ORDER") & t.is_("ASC"))
        ))
    )
    # the opening parenthesis of a closing one, the call before it and what stands before that
    m_at = t.number("m_at").astype(np.int64)
    f["m_at"] = m_at
    opened = np.where(m_at > 0, t.first + m_at - 1, -1)
    f["m_fn"] = t.codes_at("u", np.where(opened >= 0, t.place_of(opened - 1), -1))
    f["m_before"] = t.codes_at("u", np.where(opened >= 0, t.place_of(opened - 2), -1))
    return f


def faults_of(t: Tokens, balance: np.ndarray) -> pa.Array:
    """Per token what is broken there (see ``tokens.fault_case``)."""
    u, is_ = t.among, t.is_
    starts = [s.upper() for s in K.STARTERS + K.OTHER_STARTERS]
    ends = ("WHERE", "GROUP", "HAVING", "LIMIT", "ORDER", ";")
    lax = t.in_dialects(("bigquery", "duckdb", "snowflake"))
    cases = [
        (u((";", None), 1) & t.among(("word", "kw"), 0, "kind") & ~u(starts), "unknown statement"),
        (is_("SELECT") & u(("FROM", "WHERE", ";", None), -1), "empty select list"),
        (is_("JOIN") & u(("ON", "USING", "WHERE", ";", None), -1), "join without a table"),
        (is_("FROM", 1) & u(ends), "missing table"),
        (u(("WHERE", "AND", "OR", "HAVING"), 1) & u((*ends, "AND", "OR")), "empty condition"),
        (u(("WHERE", "HAVING", "AND", "OR", "FROM")) & u((None,), -1), "unfinished clause"),
        (is_(",", 1) & u((",", "WHERE", "GROUP", "ORDER", "HAVING")), "stray comma"),
        (is_(",", 1) & is_("FROM") & ~lax, "stray comma"),
        (is_("GROUP") & ~is_("BY", -1) & ~u((".", "WITHIN", "EXCLUDE"), 1), "GROUP without BY"),
        (is_("ORDER") & ~u(("BY", "SIBLINGS"), -1) & ~is_(".", 1), "ORDER without BY"),
        (is_("{") & u(("{", "%", "#"), -1), "template text"),
        (is_("op", 0, "kind") & u(("'", '"', "`")), "unterminated quote"),
        (balance < 0, "unbalanced parentheses"),
    ]
    out = t.columns["fault"]
    which = np.full(t.size, -1)
    for i, (mask, _) in reversed(list(enumerate(cases))):
        which[mask] = i
    if not (which >= 0).any():
        return out
    told = pa.array([name for _, name in cases]).take(pa.array(which, mask=which < 0))
    return pc.coalesce(told, out)


def token_flags(t: Tokens, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rules decided by a token and its neighbours (see ``tokens.TOKEN_FLAGS``)."""
    u, is_ = t.among, t.is_
    word_at = lambda codes, words: t.words("u").table(words)[codes]
    not_set = ~t.is_("SET", 0, "clause")
    null = is_("NULL", -1) | (is_("NULL", 1) & ~u(("IS", "NOT"), 2))
    closing = is_(")")
    ends = ("AND", "OR", ")", ",", ";", None, "THEN", "ELSE", "END", "WHEN", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "JOIN", "LEFT", "WHERE", "AS", "FROM")
    opens = ("WHERE", "AND", "OR", "ON", "(", ",", "NOT", "WHEN", "HAVING", "SELECT", "THEN", "ELSE", "QUALIFY", "SET")
    return {
        "l07": t.is_("select", 0, "okind") & is_("IN", 1) & (is_("NOT", 2) | is_("NOT", 3) | (is_(".", 3) & is_("NOT", 5))),
        "l15": closing & word_at(f["m_fn"], tuple(K.COALESCES)) & ((word_at(f["m_before"], ("=",)) & u(ends, -1)) | (is_("=", -1) & word_at(f["m_before"], opens))),
        "l17": f["is_tab"] & t.is_("INTO", 0, "clause") & (~is_("(", -1) | u(("SELECT", "WITH"), -2)),
        "l24": is_("OVER") & (t.number("in_agg") > 0),
        "l25eq": is_("=") & not_set & null,
        "l25ne": u(("<>", "!=")) & not_set & null,
        "l08cast": f["is_col"] & f["in_where"] & is_("::", -1),
    }


def token_details(t: Tokens) -> dict[str, tuple[np.ndarray, list[str]]]:
    """Places and quoted literals of the rules decided by neighbours that quote one (see ``tokens.TOKEN_DETAILS``)."""
    text = t.columns["text"]
    like = np.flatnonzero(t.among(("LIKE", "ILIKE")) & t.is_("str", -1, "kind"))
    quoted = text.take(pa.array(like + 1)).to_pylist()
    likes = [(p, x) for p, x in zip(like.tolist(), quoted) if x[1:2] == "%"]
    between = np.flatnonzero(t.is_("AND") & t.is_("BETWEEN", 2) & t.is_("str", 1, "kind") & t.is_("str", -1, "kind"))
    pairs = zip(between.tolist(), text.take(pa.array(between - 1)).to_pylist(), text.take(pa.array(between + 1)).to_pylist())
    days = [(p, f"{a} AND {b}") for p, a, b in pairs if _DAY.search(a) and _DAY.search(b)]
    return {k: (np.array([p for p, _ in v], np.int64), [x for _, x in v]) for k, v in (("l06", likes), ("l19", days))}


class Groups:
    """Tokens dealt into groups: the tokens of each in order, and aggregates over them."""

    def __init__(self, of: np.ndarray, order: np.ndarray, starts: np.ndarray):
        self.of, self.order, self.starts = of, order, starts
        self.count = len(starts)

    def any_(self, mask: np.ndarray) -> np.ndarray:
        out = np.zeros(self.count, bool)
        out[self.of[mask]] = True
        return out

    def number(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[mask], minlength=self.count).astype(np.int64)

    def firsts(self, mask: np.ndarray) -> np.ndarray:
        """The place of the first token of each group that is in ``mask``, or -1."""
        out = np.full(self.count, -1, np.int64)
        places = np.flatnonzero(mask)[::-1]
        out[self.of[places]] = places
        return out

    def lasts(self, mask: np.ndarray) -> np.ndarray:
        out = np.full(self.count, -1, np.int64)
        places = np.flatnonzero(mask)
        out[self.of[places]] = places
        return out

    def members(self, mask: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(places in ``mask``, group by group, offsets of the groups)."""
        places = self.order[mask[self.order]]
        return places, _offsets(np.bincount(self.of[places], minlength=self.count))

    def greatest(self, mask: np.ndarray, column: pa.Array) -> pa.Array:
        """The greatest of a string column's values in ``mask`` per group, by their bytes."""
        places = self.order[mask[self.order]]
        starts = _runs(self.of[places])
        ends = np.r_[starts[1:], len(places)] if len(starts) else starts
        best = np.full(self.count, -1, np.int64)
        best[self.of[places[starts]]] = places[starts]
        several = np.flatnonzero(ends - starts > 1)
        if len(several):
            values = column.take(pa.array(places)).to_pylist()
            for s, e in zip(starts[several].tolist(), ends[several].tolist()):
                there = [i for i in range(s, e) if values[i] is not None]
                if there:
                    best[self.of[places[s]]] = places[max(there, key=lambda i: values[i].encode())]
        return column.take(pa.array(best, mask=best < 0))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), INT)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _grouped(*keys: np.ndarray) -> Groups:
    """Groups by all keys, sorted by them; the tokens of a group stay in order."""
    code = keys[0].astype(np.int64)
    for key in keys[1:]:
        key = key.astype(np.int64)
        low, span = (int(key.min()), int(key.max()) - int(key.min()) + 1) if len(key) else (0, 1)
        _, code = np.unique(code, return_inverse=True) if len(code) else (None, code)
        code = code.astype(np.int64) * span + (key - low)
    order = np.argsort(code, kind="stable")
    starts = _runs(code[order])
    of = np.empty(len(code), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(code)]))
    return Groups(of, order, starts)


def _struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _where(values: np.ndarray, there: np.ndarray, type_: pa.DataType) -> pa.Array:
    return pa.array(values, type_, mask=~there)


def _struct_or_null(there: np.ndarray, **columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=pa.array(~there))


def _lists(t: Tokens, f: dict[str, np.ndarray], wanted: Sequence[str]) -> dict[str, tuple]:
    """Per list fact: (mask of its tokens, what makes the entries from places)."""
    u, is_ = t.among, t.is_
    closing, over = is_(")"), t.is_("over", 0, "fkind")
    word_at = lambda codes, words: t.words("u").table(words)[codes]
    ints = lambda x, type_=INT: lambda p: pa.array(x[p], type_)
    pos, scope, arm = ints(t.pos), ints(t.number("scope"), LONG), ints(f["arm"], LONG)
    clause = lambda p: t.strings("clause", p)
    flag = lambda x: lambda p: pa.array(x[p], BOOL)
    before = lambda p: _where(f["m_at"][p], f["m_at"][p] > 0, INT)
    neighbour = lambda name, back: lambda p: t.strings(name, t.place_of(t.place - back)[p])
    low = lambda p: pa.array([x.lower() for x in t.strings("name", p).to_pylist()], STR)
    plain = (t.number("in_agg") <= 0) & (t.number("in_over") <= 0) & (t.number("in_filter") <= 0)
    types = tuple(K.TYPES)
    parts = {
        "cols": lambda: (f["is_col"], lambda p: _struct(
            pos=pos(p), qual=t.strings("name", f["qual_at"][p]), name=pc.fill_null(t.strings("name", p), "*"), db=t.strings("name", f["db_at"][p]),
            scope=scope(p), arm=arm(p), clause=clause(p), plain=flag(plain)(p), in_where=flag(f["in_where"])(p),
        )),
        "aggs": lambda: (f["is_fn"] & u(K.AGGREGATES), lambda p: _struct(pos=pos(p), scope=scope(p), arm=arm(p), clause=clause(p), in_over=flag(t.number("in_over") > 0)(p))),
        "wins": lambda: (closing & is_("OVER", -1), lambda p: _struct(o=before(p), z=pos(p))),
        "wraps": lambda: (closing & f["in_where"] & (word_at(f["m_fn"], tuple(K.WRAPPERS)) | is_("::", -1)), lambda p: _struct(o=before(p), z=pos(p))),
        "ops": lambda: (
            t.among(AND_CLAUSES, 0, "clause") & ((t.number("cases") == 0) | ~t.number("direct")) & u(OPERATORS),
            lambda p: _struct(pos=pos(p), frame=t.columns["frame"].take(pa.array(p)), u=t.strings("u", p), n1=neighbour("u", -1)(p)),
        ),
        "over_cols": lambda: (
            f["is_col"] & t.there("name") & over & word_at(f["start"], ("BY", ",")) & u((",", ")", "ORDER", "ASC", "DESC", "ROWS", "RANGE", "GROUPS", "NULLS"), -1), low,
        ),
        "ranked": lambda: (closing & is_("OVER", -1) & word_at(f["m_fn"], tuple(K.NEEDS_ORDER)), lambda p: _struct(pos=pos(p), n2=neighbour("u", -2)(p))),
        "over_orders": lambda: (is_("ORDER") & over & pc.is_valid(t.columns["frame"]).to_numpy(zero_copy_only=False), lambda p: t.columns["frame"].take(pa.array(p))),
        "ctes": lambda: (
            t.there("name") & t.is_("WITH", 0, "clause") & t.number("direct") & u(("WITH", ",", "RECURSIVE"), 1) & u(("AS", "("), -1), low,
        ),
        "gaps": lambda: (
            t.number("direct") & t.is_("SELECT", 0, "clause") & t.is_("word", 0, "kind") & t.is_("word", 1, "kind") & ~u(types) & ~u(types, 1),
            lambda p: _struct(pos=pos(p), line=pa.array(t.number("line")[p], INT), a=neighbour("text", 1)(p), b=t.strings("text", p)),
        ),
    }
    return {k: parts[k]() for k in wanted}


def _shown(t: Tokens) -> pa.Array:
    """Keywords print in upper case."""
    return pc.if_else(pa.array(t.is_("kw", 0, "kind")), t.columns["u"], t.columns["text"])


def _segment_facts(t: Tokens, f: dict[str, np.ndarray], g: Groups, wanted: Sequence[str]) -> dict[str, pa.Array]:
    """The facts of ``tokens.segments`` asked for, one entry per group."""
    u, is_, direct, core = t.among, t.is_, t.number("direct"), f["core"]
    clause = lambda *words: t.among(words, 0, "clause")
    after = lambda *words: u(words, 1)
    lead = g.order[g.starts] if g.count else np.zeros(0, np.int64)  # the first token of each segment
    tail = g.order[np.r_[g.starts[1:], t.size] - 1] if g.count else np.zeros(0, np.int64)
    at_scope = g.firsts(t.pos == t.number("scope"))  # the token that opens the scope, in its segment
    c0 = g.firsts(core)
    last_core = g.lasts(core)
    close_at = np.where(last_core >= 0, f["m_at"][last_core], -1) if t.size else np.zeros(0, np.int64)
    pos0 = np.where(c0 >= 0, t.pos[c0], -2) if t.size else np.zeros(0, np.int64)
    u0 = t.codes_at("u", c0) if t.size else np.zeros(0, np.int64)
    word0 = lambda *words: t.words("u").table(words)[u0]
    n_core = g.number(core)
    get = {
        "stmt": lambda: pa.array(t.number("stmt")[lead], LONG),
        "scope": lambda: pa.array(t.number("scope")[lead], LONG),
        "arm": lambda: pa.array(f["arm"][lead], LONG),
        "clause": lambda: t.strings("clause", lead),
        "seg": lambda: pa.array(t.number("seg")[lead], LONG),
        "s": lambda: pa.array(t.pos[lead], INT),
        "e": lambda: pa.array(t.pos[tail], INT),
        "src_no": lambda: pa.array(t.number("src_no")[lead], LONG),
        "n_setop": lambda: pa.array(t.number("n_setop")[lead], LONG),
        "c0": lambda: _where(pos0, c0 >= 0, INT),
        "n_core": lambda: pa.array(n_core, LONG),
        "txt": lambda: _joined(_shown(t), *g.members(core), " "),
        "bare": lambda: pa.array(np.isin(n_core, (1, 3, 5)) & (g.number(core & (t.there("name") | is_(".") | (is_("*") & is_(".", 1)))) == n_core) & (g.number(f["is_col"]) == 1)),
        "ordinal": lambda: pa.array(
            (g.number(core & ~(direct & clause("ORDER") & (u(("DESC", "NULLS")) | after("NULLS")))) == 1) & g.any_(core & t.is_("num", 0, "kind"))
        ),
        "agg_item": lambda: pa.array(word0(*K.AGGREGATES) & (close_at == pos0 + 1)),
        "wrapped": lambda: pa.array(word0("(") & (close_at == pos0)),
        "star": lambda: pa.array(g.any_(direct & is_("*") & (after("SELECT", ",", "DISTINCT", "ALL") | is_("TOP", 2)))),
        "distinct": lambda: pa.array(g.any_(direct & is_("DISTINCT") & after("SELECT"))),
        "top": lambda: pa.array(g.any_(direct & is_("TOP") & after("SELECT", "DISTINCT") & t.is_("num", -1, "kind"))),
        "alias": lambda: g.greatest(f["is_ialias"], t.columns["name"]),
        "src": lambda: g.greatest(f["is_src"], t.columns["name"]),
        "is_tab": lambda: pa.array(g.any_(f["is_tab"])),
        "src_alias": lambda: g.greatest(f["is_salias"], t.columns["name"]),
        **{f"j_{k}": lambda k=k: pa.array(g.any_(direct & clause("JOIN") & is_(k.upper()))) for k in JOIN_SIDES},
        "opener": lambda: pc.if_else(pa.array(at_scope >= 0), pc.fill_null(t.strings("u", np.where(at_scope >= 0, t.place_of(t.place - 2)[at_scope], -1)), ""), pa.scalar(None, STR)),
        "up": lambda: _highest(t, "up", g),
        "fn_opener": lambda: pa.array((at_scope >= 0) & t.there("name", 2)[at_scope]) if t.size else pa.array([], BOOL),
        "sub_select": lambda: _where(t.number("sub_select")[at_scope], at_scope >= 0, LONG) if t.size else pa.array([], LONG),
        "in_exists": lambda: pa.array(g.any_(t.number("in_exists") > 0)),
    }
    out = {k: get[k]() for k in wanted if k in get}
    for k, (mask, entries) in _lists(t, f, [k for k in wanted if k in LISTS]).items():
        places, offsets = g.members(mask)
        out[k] = pa.ListArray.from_arrays(offsets, entries(places))
    return {k: out[k] for k in wanted}


def _joined(column: pa.Array, places: np.ndarray, offsets: pa.Array, sep: str) -> pa.Array:
    """The strings of each group as one."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets, column.take(pa.array(places))), sep)


def _highest(t: Tokens, name: str, g: Groups) -> pa.Array:
    there = np.flatnonzero(pc.is_valid(t.columns[name]).to_numpy(zero_copy_only=False))
    out = np.full(g.count, np.iinfo(np.int64).min, np.int64)
    np.maximum.at(out, g.of[there], t.number(name)[there])
    return _where(out, out > np.iinfo(np.int64).min, LONG)


#: list facts of a segment
LISTS = ["cols", "aggs", "wins", "wraps", "ops", "over_cols", "ranked", "over_orders", "ctes", "gaps"]
TYPES = {
    "cols": "array<struct<pos:int,qual:string,name:string,db:string,scope:bigint,arm:bigint,clause:string,plain:boolean,in_where:boolean>>",
    "aggs": "array<struct<pos:int,scope:bigint,arm:bigint,clause:string,in_over:boolean>>",
    "wins": "array<struct<o:int,z:int>>", "wraps": "array<struct<o:int,z:int>>", "ops": "array<struct<pos:int,frame:bigint,u:string,n1:string>>",
    "over_cols": "array<string>", "ranked": "array<struct<pos:int,n2:string>>", "over_orders": "array<bigint>", "ctes": "array<string>",
    "gaps": "array<struct<pos:int,line:int,a:string,b:string>>",
    **{k: "bigint" for k in ("stmt", "scope", "arm", "seg", "src_no", "n_setop", "n_core", "sub_select", "up")}, **{k: "int" for k in ("s", "e", "c0")},
    **{k: "string" for k in ("clause", "txt", "alias", "src", "src_alias", "opener")},
    **{k: "boolean" for k in ("bare", "ordinal", "agg_item", "wrapped", "star", "distinct", "top", "is_tab", "fn_opener", "in_exists", *(f"j_{k}" for k in JOIN_SIDES))},
}
FLAGS = ["l07", "l15", "l17", "l24", "l25eq", "l25ne", "l08cast"]
DETAILS = ["l06", "l19"]
COUNTS = ["v_starts", "n_case", "n_else", "n_union", "n_union_inner"]
ADJACENT = "struct<pos:int,line:int,a:string,b:string>"
FAULT, LAST = "struct<pos:int,kind:string,line:int,at:int>", "struct<pos:int,bal:bigint,line:int,at:int>"
VERDICTS = {
    **{f"t_{k}": "boolean" for k in FLAGS}, **{f"d_{k}": "struct<pos:int,x:string>" for k in DETAILS}, "v_fault": FAULT, "v_last": LAST, "v_adjacent": ADJACENT, **{k: "bigint" for k in COUNTS},
}


def _verdicts(t: Tokens, f: dict[str, np.ndarray], g: Groups, wanted: Sequence[str]) -> dict[str, pa.Array]:
    """Flags, quoted details, faults and counts per group of tokens."""
    out: dict[str, pa.Array] = {}
    if any(k.startswith("t_") for k in wanted):
        out |= {f"t_{k}": pa.array(g.any_(mask)) for k, mask in token_flags(t, f).items()}
    if any(k.startswith("d_") for k in wanted):
        for k, (places, shown) in token_details(t).items():
            first = np.full(g.count, -1, np.int64)
            first[g.of[places[::-1]]] = np.arange(len(places))[::-1]
            there = first >= 0
            take = pa.array(first, mask=~there)
            out[f"d_{k}"] = _struct_or_null(there, pos=pa.array(t.pos[places], INT).take(take), x=pa.array(shown, STR).take(take))
    depth = t.number("depth")
    line, at = t.columns.get("line"), t.columns.get("at")
    if "v_fault" in wanted:
        broken = faults_of(t, depth)
        first = g.firsts(pc.is_valid(broken).to_numpy(zero_copy_only=False))
        take = pa.array(first, mask=first < 0)
        out["v_fault"] = _struct_or_null(first >= 0, pos=pa.array(t.pos, INT).take(take), kind=broken.take(take), line=line.take(take), at=at.take(take))
    if "v_last" in wanted:
        last = pa.array(g.lasts(np.ones(t.size, bool)))
        bal = depth + t.is_("(")
        out["v_last"] = _struct(pos=pa.array(t.pos, INT).take(last), bal=pa.array(bal, LONG).take(last), line=line.take(last), at=at.take(last))
    if "v_adjacent" in wanted:
        out["v_adjacent"] = _first_adjacent(t, g)
    union = t.is_("SETOP", 0, "ckw") & t.is_("UNION")
    setop = t.number("setop_at").astype(np.int64)
    before = np.where(setop > 0, t.place_of(t.first + setop - 1), -1)
    again = np.where(setop > 0, t.place_of(t.first + setop), -1)
    word_at = lambda places, word: t.words("u").table((word,))[t.codes_at("u", places)]
    masks = {
        "v_starts": ~t.is_(";") & t.among((";", None), 1), "n_case": t.is_("CASE"), "n_else": t.is_("ELSE"), "n_union": union & ~t.is_("ALL", -1),
        "n_union_inner": union & word_at(before, "UNION") & ~word_at(again, "ALL"),
    }
    out |= {k: pa.array(g.number(mask), LONG) for k, mask in masks.items() if k in wanted}
    return {k: out[k] for k in wanted}


def array_of(types: dict[str, str]) -> str:
    return f"array<struct<{', '.join(f'{k}:{v}' for k, v in types.items())}>>"


def _segment_groups(t: Tokens) -> Groups:
    # a segment is numbered within its scope; a statement's scopes are its own
    return _grouped(t.text_no, t.number("stmt"), t.number("scope"), t.number("seg"))


def _per_text(values: pa.Array, text_no: np.ndarray, texts: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(_offsets(np.bincount(text_no, minlength=texts)), values)


def segments_of(t: Tokens, wanted: Sequence[str]) -> pa.ListArray:
    """Per text its segments: structs of the ``wanted`` facts."""
    f, g = scope_facts(t), _segment_groups(t)
    out = _segment_facts(t, f, g, [k for k in wanted if k not in VERDICTS])
    out |= _verdicts(t, f, g, [k for k in wanted if k in VERDICTS])
    lead = g.order[g.starts] if g.count else np.zeros(0, np.int64)
    return _per_text(_struct(**{k: out[k] for k in wanted}), t.text_no[lead], t.texts)


#: lists of a statement, over its segments
GATHERED = ["cols", "aggs", "wins", "wraps", "ranked", "over_orders", "ctes", "gaps"]
ARM = {
    "scope": "bigint", "arm": "bigint", "s": "int", "e": "int", "n_setop": "bigint", "distinct": "boolean", "top": "boolean", "opener": "string", "fn_opener": "boolean",
    "sub_select": "bigint", "in_exists": "boolean",
}


def statement_types(segment: Sequence[str], wanted: Sequence[str]) -> dict[str, str]:
    """The ``wanted`` columns of a statement with their types; ``segment``: the facts its segments carry."""
    segs = ", ".join(f"{k}:{TYPES[k]}" for k in segment)
    arm = ", ".join(f"{k}:{v}" for k, v in ARM.items())
    every = {"stmt": "bigint", "sels": f"array<struct<{arm}, segs:array<struct<{segs}>>>>", **{k: TYPES[k] for k in GATHERED}, **VERDICTS}
    every["tabs"] = "array<struct<name:string,alias:string,clause:string>>"
    return {k: every[k] for k in every if k == "stmt" or k in wanted}


def statements_of(t: Tokens, segment: Sequence[str], wanted: Sequence[str]) -> pa.ListArray:
    """Per text its statements (``statement_types``): SELECT arms with their segments, columns, sources and flags."""
    f, g = scope_facts(t), _segment_groups(t)
    columns = list(statement_types(segment, wanted))
    statement = _grouped(t.text_no, t.number("stmt"))  # already in order
    head = statement.order[statement.starts] if statement.count else np.zeros(0, np.int64)
    out: dict[str, pa.Array] = {"stmt": pa.array(t.number("stmt")[head], LONG)}
    for k, (mask, entries) in _lists(t, f, [k for k in GATHERED if k in columns]).items():
        places, offsets = statement.members(mask)
        out[k] = pa.ListArray.from_arrays(offsets, entries(places))
    out |= _verdicts(t, f, statement, [k for k in columns if k in VERDICTS])
    if "sels" in columns or "tabs" in columns:
        # segments by statement, scope, arm and place: an arm is a run of them, a statement a run of arms
        lead = g.order[g.starts] if g.count else np.zeros(0, np.int64)
        own, scope, arm = statement.of[lead], t.number("scope")[lead], f["arm"][lead]
        by = np.lexsort((t.pos[lead], arm, scope, own))
        facts = _segment_facts(t, f, g, list(dict.fromkeys([*segment, *(k for k in ARM if k not in ("s", "e")), "s", "e", "src", "src_alias", "is_tab", "clause"])))
        facts = {k: v.take(pa.array(by)) for k, v in facts.items()}
        own, scope, arm = own[by], scope[by], arm[by]
        new_scope = np.r_[True, (own[1:] != own[:-1]) | (scope[1:] != scope[:-1])] if len(by) else np.zeros(0, bool)
        starts = np.flatnonzero(new_scope | np.r_[True, arm[1:] != arm[:-1]]) if len(by) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(by)])
        scope_no = np.cumsum(new_scope) - 1  # facts of the scope, known only to the segment that opens it
    if "sels" in columns:
        flag = lambda name: np.logical_or.reduceat(facts[name].to_numpy(zero_copy_only=False), starts) if len(by) else np.zeros(0, bool)
        arm_scope = scope_no[starts]
        shared = lambda name: facts[name].take(_opening(facts["opener"], scope_no, arm_scope))
        s, e, n_setop = (facts[k].to_numpy() for k in ("s", "e", "n_setop"))
        most = np.full(int(scope_no[-1]) + 1 if len(by) else 0, -1, np.int64)
        np.maximum.at(most, scope_no, n_setop)
        fn = np.zeros(len(most), bool)
        fn[scope_no[facts["fn_opener"].to_numpy(zero_copy_only=False)]] = True
        arms = _struct(
            scope=pa.array(scope[starts], LONG), arm=pa.array(arm[starts], LONG),
            s=pa.array(s[starts], INT), e=pa.array(np.maximum.reduceat(e, starts) if len(by) else e, INT), n_setop=pa.array(most[arm_scope], LONG),
            distinct=pa.array(flag("distinct")), top=pa.array(flag("top")), opener=shared("opener"), fn_opener=pa.array(fn[arm_scope]),
            sub_select=shared("sub_select"), in_exists=pa.array(flag("in_exists")),
            segs=pa.ListArray.from_arrays(_offsets(sizes), _struct(**{k: facts[k] for k in segment})),
        )
        out["sels"] = pa.ListArray.from_arrays(_offsets(np.bincount(own[starts], minlength=statement.count)), arms)
    if "tabs" in columns:
        tabs = np.flatnonzero(facts["is_tab"].to_numpy(zero_copy_only=False))
        take = pa.array(tabs)
        name = facts["src"].take(take)
        entries = _struct(name=name, alias=pc.coalesce(facts["src_alias"].take(take), name), clause=facts["clause"].take(take))
        out["tabs"] = pa.ListArray.from_arrays(_offsets(np.bincount(own[tabs], minlength=statement.count)), entries)
    return _per_text(_struct(**{k: out[k] for k in columns}), t.text_no[head], t.texts)


def _opening(opener: pa.Array, scope_no: np.ndarray, arm_scope: np.ndarray) -> pa.Array:
    """Per arm the segment that opens its scope; null where none does (the statement itself)."""
    there = np.flatnonzero(pc.is_valid(opener).to_numpy(zero_copy_only=False))
    at = np.full(int(scope_no[-1]) + 1 if len(scope_no) else 0, -1, np.int64)
    at[scope_no[there]] = there
    at = at[arm_scope]
    return pa.array(at, mask=at < 0)


def _blank(t: Tokens) -> pa.Array:
    """The blank before each token in printed SQL (see ``tokens.SPACING``)."""
    u, word = t.among, t.is_("word", 1, "kind")
    tight = (
        u((None, ".", "(", "::", "["), 1) | u((".", ",", ")", ";", "::", "]")) | (t.is_("(") & (word | u(("LEFT", "RIGHT", "REPLACE"), 1))) | (t.is_("[") & word)
    )
    return pc.if_else(pa.array(tight), "", " ")


def _printed(t: Tokens, g: Groups, mask: np.ndarray) -> pa.Array:
    """The tokens in ``mask`` of each group as text."""
    parts = pc.binary_join_element_wise(_blank(t), _shown(t), "")
    return pc.utf8_trim(_joined(parts, *g.members(mask), ""), " ")


ROOT_ITEM = {
    "stmt": "bigint", "rseg": "bigint", "clause": "string", "src_no": "bigint", "arm": "bigint", "n_setop": "bigint", "txt": "string", "alias": "string", "col_name": "string",
    "n_core": "bigint", "n_path": "bigint", "src": "string", "is_tab": "boolean", "src_alias": "string", "kind": "string", "has_agg": "boolean", "has_or": "boolean", "s": "int",
}


def root_items_of(t: Tokens) -> pa.ListArray:
    """Per text the segments of its outermost SELECTs (see ``tokens.root_items``)."""
    f = scope_facts(t)
    g = _grouped(t.text_no, t.number("stmt"), t.number("rseg"))
    lead = g.order[g.starts] if g.count else np.zeros(0, np.int64)
    outer, direct, names = t.number("scope") < 0, t.number("direct"), t.columns["name"]
    keep, own = ~outer | f["core"], outer & (t.number("seg") == t.number("rseg"))
    first = g.firsts(own)  # the own tokens of a segment agree in these
    told = lambda x: _where(x[first], first >= 0, LONG) if t.size else pa.array([], LONG)
    joins = own & direct & t.is_("JOIN", 0, "clause") & t.among(JOIN_WORDS)
    out = {
        "stmt": pa.array(t.number("stmt")[lead], LONG), "rseg": pa.array(t.number("rseg")[lead], LONG), "clause": t.strings("clause", first),
        "src_no": told(t.number("src_no")), "arm": told(t.number("arm0")), "n_setop": told(t.number("n_setop")),
        "txt": _printed(t, g, keep), "alias": g.greatest(own & f["is_ialias"], names), "col_name": g.greatest(own & f["is_col"], names),
        "n_core": pa.array(g.number(keep), LONG), "n_path": pa.array(g.number(keep & (t.there("name") | t.is_("."))), LONG),
        "src": g.greatest(own & f["is_src"], names), "is_tab": pa.array(g.any_(own & f["is_tab"])), "src_alias": g.greatest(own & f["is_salias"], names),
        "kind": _joined(t.columns["u"], *g.members(joins), " "), "has_agg": pa.array(g.any_(f["is_fn"] & t.among(K.AGGREGATES))),
        "has_or": pa.array(g.any_(own & direct & t.is_("OR") & (t.number("cases") == 0))), "s": pa.array(t.pos[lead], INT),
    }
    return _per_text(_struct(**out), t.text_no[lead], t.texts)


VALIDITY = {"f": "struct<pos:int,kind:string,line:int>", "z": "struct<bal:bigint,line:int>", "statement_count": "int", "form": "string", "adj": ADJACENT}


def _first_adjacent(t: Tokens, g: Groups) -> pa.Array:
    """The first two values side by side in each group."""
    values = ("word", "num", "str")
    side_by_side = t.among(values, 0, "kind") & (t.among(values, 1, "kind") | t.is_(")", 1)) & ~(t.is_("word", 0, "kind") & t.is_("word", 1, "kind"))
    first = g.firsts(side_by_side)
    there, take = first >= 0, pa.array(first, mask=first < 0)
    return _struct_or_null(
        there, pos=pa.array(t.pos, INT).take(take), line=t.columns["line"].take(take), a=t.strings("text", np.where(there, first - 1, -1)), b=t.columns["text"].take(take)
    )


def validity_of(t: Tokens) -> pa.StructArray:
    """Per text what ``rules.validity`` judges by: first fault, balance at the end, number of statements, printed form, first values side by side; null without tokens."""
    g = _grouped(t.text_no)
    bal = t.number("depth") + t.is_("(")
    broken = faults_of(t, bal)
    first = g.firsts(pc.is_valid(broken).to_numpy(zero_copy_only=False))
    take, last = pa.array(first, mask=first < 0), pa.array(g.lasts(np.ones(t.size, bool)))
    line = t.columns["line"]
    found = _struct(
        f=_struct_or_null(first >= 0, pos=pa.array(t.pos, INT).take(take), kind=broken.take(take), line=line.take(take)),
        z=_struct(bal=pa.array(bal, LONG).take(last), line=line.take(last)),
        statement_count=pa.array(g.number(~t.is_(";") & t.among((";", None), 1)), INT),
        form=_printed(t, g, ~t.is_(";")),
        adj=_first_adjacent(t, g),
    )
    at = np.full(t.texts, -1, np.int64)
    at[t.text_no[g.order[g.starts]] if g.count else np.zeros(0, np.int64)] = np.arange(g.count)
    return found.take(pa.array(at, mask=at < 0))
