"""From SQL texts to token and fact tables.

Everything is partitioned by the text id ``tid``: there is one shuffle of texts, in
the dedupe aggregate. What whole texts give (``whole``) is made where a text is walked.
A table of tokens costs one more shuffle, of their facts; every group-by below uses keys
that begin with ``tid`` and needs none. No text is refused for its length.

A tree walk is a fold over the tokens of a text with an explicit stack
(``plans.fold``, ``plans.grammar``): one pass in Arrow batches gives frames, scopes,
clauses, segments and grammar faults, without a window or a sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from queryscope.functions import words as K
from queryscope.functions.text import HASH_COMMENTS, bare, strip_jinja, tokens
from queryscope.plans import shape as S
from queryscope.plans.fold import COLUMNS, GIVEN, NEIGHBOURS, facts_of, given_for
from queryscope.plans.shape import AND_CLAUSES, EXPR_CLAUSES, JOIN_SIDES, JOIN_WORDS, SOURCE_CLAUSES


def normalise_log(log: DataFrame, dbt_mode: bool = False) -> DataFrame:
    """Trim, default the dialect, optionally stub templates, and key each text."""
    sql = F.trim(F.coalesce("sql", F.lit("")), F.lit(" \t\r\n"))
    if dbt_mode:
        sql = strip_jinja(sql)
    known = F.col("dialect").isin(K.DIALECTS)
    d = F.when(known, F.col("dialect")).otherwise(K.DIALECTS[0])
    out = log.withColumn("dialect", d).withColumn("sql", sql)
    # 16 bytes of SHA-256: narrow, because every token row carries and sorts by it
    digest = F.unhex(F.sha2(F.concat_ws("\n", "dialect", "sql"), 256))
    return out.withColumn("tid", F.substring(digest, 1, 16))


def size_class(sql: Column) -> Column:
    """``empty``, ``too long`` for an interactive check, or ``accepted``. A report only: every text is linted."""
    bare_length = F.length(F.trim(F.coalesce(sql, F.lit("")), F.lit(" \t\r\n")))
    return F.when(bare_length == 0, "empty").when(F.length(sql) > K.MAX_SQL_CHARS, "too long").otherwise("accepted")


def distinct_texts(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per distinct text; copies collapse before the shuffle. ``partitions`` sizes the token job."""
    texts = log.groupBy("tid").agg(F.first("sql").alias("sql"), F.first("dialect").alias("dialect"), F.count("*").alias("copies"))
    return texts.repartition(partitions, "tid") if partitions else texts


def kind_of(x: str, dialect: str = "dialect") -> str:
    """Class of a token from its upper-case text ``x.u``; ``dialect`` is the text's."""
    u = f"{x}u"
    # most tokens begin with a plain letter: they are told by it, without a pattern
    return rf"""CASE
      WHEN left({u}, 1) BETWEEN 'A' AND 'Z' THEN if(right({u}, 1) IN ('\'', '"'), 'str', if({u} IN {_in_list(K.KEYWORDS)}, 'kw', 'word'))
      WHEN {u} LIKE '--%' OR {u} LIKE '/*%' OR (length({u}) > 0 AND left({u}, 1) = '#' AND {dialect} IN {_in_list(HASH_COMMENTS)}) THEN 'comment'
      WHEN length({u}) > 1 AND left({u}, 1) IN ('@', '$') THEN 'str'
      WHEN length({u}) > 1 AND left({u}, 1) = '\'' THEN 'str'
      WHEN length({u}) > 1 AND left({u}, 1) = '"' THEN if({dialect} IN {_in_list(K.DOUBLE_QUOTE_STRINGS)}, 'str', 'quoted')
      WHEN length({u}) > 1 AND left({u}, 1) = '`' THEN 'quoted'
      WHEN left({u}, 1) BETWEEN '0' AND '9' THEN 'num'
      WHEN {u} RLIKE r'^[\p{{L}}_]' THEN if({u} IN {_in_list(K.KEYWORDS)}, 'kw', 'word')
      ELSE 'op' END"""


def _breaks(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '\\n', '')))"


def token_table(texts: DataFrame) -> DataFrame:
    """tid, pos, line, raw (with leading white space), text, u (upper case), kind; comments included."""
    t = texts.select("tid", "dialect", F.posexplode(tokens(F.col("sql"), F.col("dialect"))).alias("pos", "raw"))
    t = t.withColumn("text", bare(F.col("raw")))
    t = t.selectExpr("*", "if(text = '==', '=', upper(text)) AS u")
    upto = "PARTITION BY tid ORDER BY pos ROWS UNBOUNDED PRECEDING"
    line = f"CAST(sum({_breaks('raw')}) OVER ({upto}) - {_breaks('text')} + 1 AS INT) AS line"
    return t.selectExpr("tid", "dialect", "pos", "raw", "text", "u", f"{kind_of('')} AS kind", line)


def _walkable(texts: DataFrame, given: Sequence[str], *keep: str) -> DataFrame:
    """tid, dialect, the columns to ``keep``, toks: the tokens of a text as one array, with what the walk needs to give the facts ``given``."""
    t = texts.select("tid", "dialect", *keep, tokens(F.col("sql"), F.col("dialect")).alias("raws"))
    t = t.withColumn("cut", F.transform("raws", lambda r: F.struct(r.alias("raw"), bare(r).alias("text"))))
    t = t.selectExpr("tid", "dialect", *keep, "transform(cut, c -> struct(c.raw AS raw, c.text AS text, if(c.text = '==', '=', upper(c.text)) AS u)) AS cut")
    t = t.selectExpr("tid", "dialect", *keep, f"transform(cut, c -> struct(c.raw AS raw, c.text AS text, c.u AS u, {kind_of('c.')} AS kind)) AS cut")
    # the walk goes by u and kind; everything else is only handed over if it is asked for
    made_of = {
        "text": ["c.text AS text"], "name": [f"{name_of('c.')} AS name"], "line": [f"{_breaks('c.raw')} AS breaks", f"{_breaks('c.text')} AS inner"],
        "at": ["length(c.raw) - length(c.text) AS lead", "length(c.text) AS width"],
    }
    parts = f"struct({', '.join(['c.u AS u', 'c.kind AS kind', *(x for k, xs in made_of.items() if k in given for x in xs)])})"
    return t.select("tid", "dialect", *keep, F.expr(f"transform(cut, c -> {parts})").alias("toks"))


def fact_table(texts: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """tid, dialect and the ``wanted`` facts (``plans.fold.COLUMNS``) of every token but comments, from one walk over each text.

    A text is one row until its facts are exploded: they are shuffled by ``tid`` once, and nothing is sorted.
    """
    given = given_for(list(wanted))
    row = ", ".join(f"{k}:array<{GIVEN[k]}>" for k in given)

    @F.arrow_udf(f"struct<{row}>")
    def walk(toks: pa.Array, dialect: pa.Array) -> pa.Array:
        return facts_of(toks, dialect, given)

    t = _walkable(texts, given).select("tid", "dialect", walk("toks", "dialect").alias("facts"))
    # Python evaluation hides the partitioning by tid from the planner, so it is stated again while a text is still one row;
    # then arrays side by side: each token row reads its own entry of each, no struct per token is built
    t = t.repartition("tid").select("tid", "dialect", "facts", F.posexplode(f"facts.{given[0]}").alias("_i", "_first"))
    return t.selectExpr("tid", "dialect", *[f"{_looked_up(k)} AS {k}" for k in wanted])


class Whole:
    """The tokens of whole texts, not yet taken apart: what is made of them is made where a text is walked, and a text stays one row until then.

    ``segments``, ``statements`` and ``root_items`` take it in place of a table of tokens and give the same rows.
    """

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def made(self, make: Callable[[S.Tokens], pa.Array], types: str, *keep: str) -> DataFrame:
        """tid, dialect, the columns to ``keep``, found: what ``make`` builds per text."""

        @F.arrow_udf(types)
        def walk(toks: pa.Array, dialect: pa.Array) -> pa.Array:
            return make(S.Tokens(toks, dialect))

        # not for the optimizer to repeat: the filter that it puts below a generator would walk every text a second time
        once = walk.asNondeterministic()
        return _walkable(self.texts, S.READ, *keep).select("tid", "dialect", *keep, once("toks", "dialect").alias("found"))

    def rows(self, make: Callable[[S.Tokens], pa.Array], types: str, shuffled: bool = False) -> DataFrame:
        """tid and one row for each struct that ``make`` builds."""
        t = self.made(make, types)
        # stated again for the planner where groups or joins by text follow, see ``fact_table``
        return (t.repartition("tid") if shuffled else t).select("tid", F.inline("found"))


def whole(texts: DataFrame) -> Whole:
    return Whole(texts)


def _looked_up(fact: str) -> str:
    """A token's own value of a fact, or that of a neighbour, from the arrays of its text."""
    if fact == "pos":
        return "_i + 1"
    if fact in NEIGHBOURS:
        column, back = NEIGHBOURS[fact]
        return f"get(facts.{column}, _i - {back})" if back > 0 else f"get(facts.{column}, _i + {-back})"
    if fact == "m":
        at = "get(facts.m_at, _i)"
        return f"""if({at} IS NULL, NULL, named_struct('at', {at}, 'kind', get(facts.okind, {at} - 1), 'fn', get(facts.u, {at} - 2), 'before', get(facts.u, {at} - 3)))"""
    if fact == "prev_setop":
        at = "get(facts.setop_at, _i)"
        return f"if({at} IS NULL, NULL, named_struct('u', get(facts.u, {at} - 1), 'n1', get(facts.u, {at})))"
    return f"get(facts.{fact}, _i)"


def is_comment(c: Column, dialect: Column) -> Column:
    return c.startswith("--") | c.startswith("/*") | (c.startswith("#") & dialect.isin(HASH_COMMENTS))


def comment_body(c: Column) -> Column:
    return F.when(c.startswith("--"), F.substr(c, F.lit(3))).when(c.startswith("#"), F.substr(c, F.lit(2))).otherwise(F.substr(c, F.lit(3), F.length(c) - 4))


def comments(texts: DataFrame) -> DataFrame:
    """One row per comment, straight from the token array (no window)."""
    t = texts.select("tid", "dialect", F.explode(tokens(F.col("sql"), F.col("dialect"))).alias("raw"))
    t = t.select("tid", "dialect", bare(F.col("raw")).alias("c"))
    return t.where(is_comment(F.col("c"), F.col("dialect"))).select("tid", comment_body(F.col("c")).alias("body"))


def _in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def name_of(x: str) -> str:
    """What a word or quoted token names."""
    return f"CASE {x}kind WHEN 'word' THEN {x}text WHEN 'quoted' THEN substring_index(substring({x}text, 2, length({x}text) - 2), '.', -1) END"


#: facts that ``scoped_tokens`` builds on
WALKED = list(COLUMNS)


def scoped_tokens(texts: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Tokens (comments dropped, positions dense) with frame, scope, clause, arm, segment, name and grammar facts.

    ``only``: the facts of the walk that are read, where nothing else is; the others are then not handed over by the walk.
    """
    if only is not None:
        return fact_table(texts, only)
    t = fact_table(texts, WALKED)
    t = t.selectExpr(
        "*",
        "coalesce(p1, ';') AS q1",
        "CASE WHEN n_setop > 0 AND clause IN ('ORDER', 'LIMIT', 'OFFSET') THEN 0 ELSE arm0 END AS arm",
    )

    # names: sources, aliases, columns and calls
    t = t.selectExpr(
        "*",
        "clause = 'WHERE' OR sub_where > 0 AS in_where",
        "coalesce(p1 = '.', false) AS dotted",
        "coalesce(p1 = '.' AND p3 = '.', false) AS three",
        "name IS NOT NULL AND coalesce(n1, '') <> '.' AS last_part",
        "coalesce(n1 = '(', false) AS calls",
        "coalesce(pk1 IN ('word', 'quoted', 'num', 'str') OR p1 IN (')', ']', 'END'), false) AS valueish",
        f"direct AND clause IN {_in_list([*SOURCE_CLAUSES, 'INTO'])} AS in_src",
        "CASE WHEN coalesce(p1, '') <> '.' THEN p1 WHEN coalesce(p3, '') <> '.' THEN p3 ELSE p5 END AS start",
    )
    heads = "('FROM', 'JOIN', ',', 'UPDATE', 'INTO', 'INSERT', 'OVERWRITE', 'TABLE', 'MERGE', 'USING', 'LATERAL', 'ONLY')"
    t = t.selectExpr(
        "*",
        f"last_part AND in_src AND coalesce(start IN {heads}, false) AS is_src",
        "last_part AND NOT dotted AND NOT calls AND (coalesce(p1 = 'AS', false) OR valueish) AS alias_spot",
    )
    types = _in_list(K.TYPES)
    parts = _in_list(K.DATE_PARTS)
    t = t.selectExpr(
        "*",
        "is_src AND (NOT calls OR clause = 'INTO') AS is_tab",
        "alias_spot AND in_src AND NOT is_src AND clause <> 'INTO' AS is_salias",
        "alias_spot AND direct AND clause = 'SELECT' AS is_ialias",
        f"""coalesce(p1 IN ('AS', '::', 'NULLS'), false) OR coalesce(u IN {types} AND nk1 = 'str', false) OR coalesce(n1 = '=>', false)
          OR (u IN {parts} AND (coalesce(n1 = 'FROM', false) OR coalesce(pk1 IN ('num', 'str'), false))) OR (NOT dotted AND valueish) AS noise""",
        f"clause IN {_in_list(EXPR_CLAUSES)} OR (clause IN ('FROM', 'JOIN', 'COMMA') AND NOT direct) AS col_zone",
        "CASE WHEN dotted AND (name IS NOT NULL OR u = '*') THEN name2 END AS qual",
        "CASE WHEN three AND name IS NOT NULL THEN name4 END AS db",
    )
    return t.selectExpr(
        "*",
        """coalesce(col_zone AND ((last_part AND NOT calls AND NOT is_ialias AND NOT noise)
          OR (u = '*' AND dotted AND name2 IS NOT NULL)), false) AS is_col""",
        "(name IS NOT NULL OR u IN ('LEFT', 'RIGHT', 'REPLACE')) AND calls AND NOT is_src AS is_fn",
    ).drop("last_part", "calls", "valueish", "in_src", "alias_spot", "noise", "col_zone", "three")


#: does a token belong to the expression of its segment (no keyword, separator, alias or direction)?
CORE = f"""NOT coalesce(ckw IS NOT NULL OR (brk AND u IN (',', 'AND')) OR is_ialias OR is_salias OR u = ';' OR (direct AND (
    (u = 'BY' AND q1 IN ('GROUP', 'ORDER'))
    OR (u IN ('DISTINCT', 'ALL') AND q1 = 'SELECT')
    OR (u = 'TOP' AND q1 IN ('SELECT', 'DISTINCT') AND nk1 = 'num')
    OR (kind = 'num' AND q1 = 'TOP')
    OR (u = 'AS' AND clause IN ('SELECT', 'FROM', 'JOIN', 'COMMA', 'UPDATE', 'MERGE', 'MERGESRC'))
    OR (clause = 'JOIN' AND u IN ('LEFT', 'RIGHT', 'FULL', 'INNER', 'CROSS', 'OUTER', 'NATURAL', 'SEMI', 'ANTI', 'JOIN'))
    OR (clause = 'ORDER' AND u = 'ASC'))), false)"""

#: keywords print in upper case
SHOWN = "if(kind = 'kw', u, text)"

#: blank before a token in printed SQL, judged by its left neighbour ``p1`` / ``pk1``
SPACING = """if(p1 IS NULL OR u IN ('.', ',', ')', ';', '::', ']') OR p1 IN ('.', '(', '::', '[')
    OR (u = '(' AND (coalesce(pk1 = 'word', false) OR p1 IN ('LEFT', 'RIGHT', 'REPLACE'))) OR (u = '[' AND coalesce(pk1 = 'word', false)), '', ' ')"""


def printed(cond: str) -> str:
    """Aggregate the tokens that satisfy ``cond`` into text, in order."""
    part = f"CASE WHEN {cond} THEN named_struct('pos', pos, 'x', concat({SPACING}, {SHOWN})) END"
    return f"trim(array_join(transform(array_sort(collect_list({part})), p -> p.x), ''))"


def _aggregate(df: DataFrame, keys: Sequence[str], exprs: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])


def root_items(tok: DataFrame | Whole) -> DataFrame:
    """Segments of each statement's outermost SELECT with their whole text, nested sub-selects included."""
    if isinstance(tok, Whole):
        return tok.rows(S.root_items_of, S.array_of(S.ROOT_ITEM), shuffled=True)
    t = tok.selectExpr("*", f"scope >= 0 OR {CORE} AS keep", "scope < 0 AND seg = rseg AS own")
    words = _in_list(JOIN_WORDS)
    join_kind = f"CASE WHEN own AND direct AND clause = 'JOIN' AND u IN {words} THEN named_struct('pos', pos, 'u', u) END"
    best = lambda cond, v, name: f"max(CASE WHEN {cond} THEN {v} END) AS {name}"
    return _aggregate(
        t,
        ["tid", "stmt", "rseg"],
        [
            best("own", "clause", "clause"),
            best("own", "src_no", "src_no"),
            best("own", "arm0", "arm"),
            best("own", "n_setop", "n_setop"),
            f"{printed('keep')} AS txt",
            best("own AND is_ialias", "name", "alias"),
            best("own AND is_col", "name", "col_name"),
            "count_if(keep) AS n_core",
            "count_if(keep AND (name IS NOT NULL OR u = '.')) AS n_path",
            best("own AND is_src", "name", "src"),
            "coalesce(bool_or(own AND is_tab), false) AS is_tab",
            best("own AND is_salias", "name", "src_alias"),
            f"array_join(transform(array_sort(collect_list({join_kind})), x -> x.u), ' ') AS kind",
            f"coalesce(bool_or(is_fn AND u IN {_in_list(K.AGGREGATES)}), false) AS has_agg",
            "coalesce(bool_or(own AND direct AND u = 'OR' AND cases = 0), false) AS has_or",
            "min(pos) AS s",
        ],
    )


def fault_case(balance: str) -> str:
    """What a token and its neighbours show to be broken, else the automaton's fault; ``balance``: open parentheses after the token."""
    starts = ", ".join(f"'{s.upper()}'" for s in K.STARTERS + K.OTHER_STARTERS)
    clause_words = "'WHERE', 'GROUP', 'HAVING', 'LIMIT', 'ORDER', ';'"
    return f"""CASE
      WHEN coalesce(p1, ';') = ';' AND kind IN ('word', 'kw') AND u NOT IN ({starts}) THEN 'unknown statement'
      WHEN u = 'SELECT' AND coalesce(n1, ';') IN ('FROM', 'WHERE', ';') THEN 'empty select list'
      WHEN u = 'JOIN' AND coalesce(n1, ';') IN ('ON', 'USING', 'WHERE', ';') THEN 'join without a table'
      WHEN p1 = 'FROM' AND u IN ({clause_words}) THEN 'missing table'
      WHEN p1 IN ('WHERE', 'AND', 'OR', 'HAVING') AND u IN ({clause_words}, 'AND', 'OR') THEN 'empty condition'
      WHEN u IN ('WHERE', 'HAVING', 'AND', 'OR', 'FROM') AND n1 IS NULL THEN 'unfinished clause'
      WHEN p1 = ',' AND u IN (',', 'WHERE', 'GROUP', 'ORDER', 'HAVING') THEN 'stray comma'
      WHEN p1 = ',' AND u = 'FROM' AND dialect NOT IN ('bigquery', 'duckdb', 'snowflake') THEN 'stray comma'
      WHEN u = 'GROUP' AND coalesce(n1, '') <> 'BY' AND coalesce(p1, '') NOT IN ('.', 'WITHIN', 'EXCLUDE') THEN 'GROUP without BY'
      WHEN u = 'ORDER' AND coalesce(n1, '') NOT IN ('BY', 'SIBLINGS') AND coalesce(p1, '') <> '.' THEN 'ORDER without BY'
      WHEN u = '{{' AND n1 IN ('{{', '%', '#') THEN 'template text'
      WHEN kind = 'op' AND u IN ('\\'', '"', '`') THEN 'unterminated quote'
      WHEN {balance} < 0 THEN 'unbalanced parentheses'
      ELSE fault END"""


#: rules decided by a token and its neighbours
TOKEN_FLAGS = {
    "l07": "okind = 'select' AND p1 = 'IN' AND (p2 = 'NOT' OR p3 = 'NOT' OR (p3 = '.' AND p5 = 'NOT'))",
    "l15": f"""u = ')' AND m.fn IN {_in_list(K.COALESCES)} AND (
        (m.before = '=' AND coalesce(n1, ';') IN ('AND', 'OR', ')', ',', ';', 'THEN', 'ELSE', 'END', 'WHEN', 'GROUP', 'ORDER', 'HAVING',
          'LIMIT', 'UNION', 'JOIN', 'LEFT', 'WHERE', 'AS', 'FROM'))
        OR (n1 = '=' AND m.before IN ('WHERE', 'AND', 'OR', 'ON', '(', ',', 'NOT', 'WHEN', 'HAVING', 'SELECT', 'THEN', 'ELSE', 'QUALIFY', 'SET')))""",
    "l17": "is_tab AND clause = 'INTO' AND (coalesce(n1, '') <> '(' OR n2 IN ('SELECT', 'WITH'))",
    "l24": "u = 'OVER' AND in_agg > 0",
    "l25eq": "u = '=' AND clause <> 'SET' AND (n1 = 'NULL' OR (p1 = 'NULL' AND coalesce(p2, '') NOT IN ('IS', 'NOT')))",
    "l25ne": "u IN ('<>', '!=') AND clause <> 'SET' AND (n1 = 'NULL' OR (p1 = 'NULL' AND coalesce(p2, '') NOT IN ('IS', 'NOT')))",
    "l08cast": "is_col AND in_where AND n1 = '::'",
}

_DAY = r"RLIKE r'^.\d{4}-\d{2}-\d{2}.$'"
#: rules decided by neighbours that also quote a literal
TOKEN_DETAILS = {
    "l06": ("u IN ('LIKE', 'ILIKE') AND nk1 = 'str' AND substring(nt1, 2, 1) = '%'", "nt1"),
    "l19": (f"u = 'AND' AND p2 = 'BETWEEN' AND pk1 = 'str' AND nk1 = 'str' AND pt1 {_DAY} AND nt1 {_DAY}", "concat_ws(' AND ', pt1, nt1)"),
}


#: the columns of a table of segments
SEGMENT = [
    "stmt", "scope", "arm", "clause", "seg", "s", "e", "src_no", "n_setop", "c0", "n_core", "txt", "star", "distinct", "top", "alias", "src", "is_tab", "src_alias",
    *[f"j_{k}" for k in JOIN_SIDES], "opener", "up", "fn_opener", "sub_select", "in_exists", *S.LISTS, *[k for k in S.VERDICTS if k != "v_adjacent"],
    "bare", "ordinal", "agg_item", "wrapped",
]


def segments(tok: DataFrame | Whole, wanted: Sequence[str] = SEGMENT) -> DataFrame:
    """One row per list item, condition, source or clause: the facts the rules read.

    A segment starts at a clause keyword, at a top-level comma of a list clause
    and at a top-level AND of a condition. Tokens of nested sub-selects belong
    to their own scope; positions ``s..e`` still span them. Of whole texts only the ``wanted`` facts are made.
    """
    if isinstance(tok, Whole):
        types = {k: S.TYPES.get(k) or S.VERDICTS[k] for k in wanted}
        return tok.rows(lambda t: S.segments_of(t, list(types)), S.array_of(types), shuffled=True)
    t = tok.selectExpr("*", f"{CORE} AS core")
    types = _in_list(K.TYPES)
    got = lambda cond, v, name: f"collect_list(CASE WHEN {cond} THEN {v} END) AS {name}"
    any_ = lambda cond, name: f"coalesce(bool_or({cond}), false) AS {name}"
    first_core = "CASE WHEN core THEN pos END"
    g = _aggregate(
        t,
        ["tid", "stmt", "scope", "arm", "clause", "seg"],
        [
            "min(pos) AS s",
            "max(pos) AS e",
            "max(src_no) AS src_no",
            "max(n_setop) AS n_setop",
            f"min({first_core}) AS c0",
            "count_if(core) AS n_core",
            "count_if(core AND NOT (direct AND clause = 'ORDER' AND (u IN ('DESC', 'NULLS') OR q1 = 'NULLS'))) AS n_key",
            f"array_join(transform(array_sort(collect_list(CASE WHEN core THEN named_struct('pos', pos, 'x', {SHOWN}) END)), x -> x.x), ' ') AS txt",
            "count_if(core AND (name IS NOT NULL OR u = '.' OR (u = '*' AND q1 = '.'))) AS n_path",
            "count_if(is_col) AS n_cols",
            any_("core AND kind = 'num'", "has_num"),
            any_("direct AND u = '*' AND (q1 IN ('SELECT', ',', 'DISTINCT', 'ALL') OR p2 = 'TOP')", "star"),
            any_("direct AND u = 'DISTINCT' AND q1 = 'SELECT'", "distinct"),
            any_("direct AND u = 'TOP' AND q1 IN ('SELECT', 'DISTINCT') AND nk1 = 'num'", "top"),
            f"min_by(u, {first_core}) AS u0",
            f"max_by(m.at, {first_core}) AS close_at",
            "max(CASE WHEN is_ialias THEN name END) AS alias",
            "max(CASE WHEN is_src THEN name END) AS src",
            any_("is_tab", "is_tab"),
            "max(CASE WHEN is_salias THEN name END) AS src_alias",
            *[any_(f"direct AND clause = 'JOIN' AND u = '{k.upper()}'", f"j_{k}") for k in JOIN_SIDES],
            "max(CASE WHEN pos = scope THEN coalesce(p2, '') END) AS opener",
            "max(up) AS up",
            any_("pos = scope AND name2 IS NOT NULL", "fn_opener"),
            "max(CASE WHEN pos = scope THEN sub_select END) AS sub_select",
            any_("in_exists > 0", "in_exists"),
            got(
                "is_col",
                """named_struct('pos', pos, 'qual', qual, 'name', coalesce(name, '*'), 'db', db, 'scope', scope, 'arm', arm, 'clause', clause,
                  'plain', in_agg <= 0 AND in_over <= 0 AND in_filter <= 0, 'in_where', in_where)""",
                "cols",
            ),
            got(
                f"is_fn AND u IN {_in_list(K.AGGREGATES)}",
                "named_struct('pos', pos, 'scope', scope, 'arm', arm, 'clause', clause, 'in_over', in_over > 0)",
                "aggs",
            ),
            got("u = ')' AND n1 = 'OVER'", "named_struct('o', m.at, 'z', pos)", "wins"),
            got(f"u = ')' AND in_where AND (m.fn IN {_in_list(K.WRAPPERS)} OR n1 = '::')", "named_struct('o', m.at, 'z', pos)", "wraps"),
            got(
                f"""clause IN {_in_list(AND_CLAUSES)} AND (cases = 0 OR NOT direct)
                  AND u IN ('OR', 'IS', 'IN', 'LIKE', 'ILIKE', 'BETWEEN', 'EXISTS', '=', '<>', '!=', '<', '>', '<=', '>=')""",
                "named_struct('pos', pos, 'frame', frame, 'u', u, 'n1', n1)",
                "ops",
            ),
            got(
                """is_col AND fkind = 'over' AND start IN ('BY', ',')
                  AND n1 IN (',', ')', 'ORDER', 'ASC', 'DESC', 'ROWS', 'RANGE', 'GROUPS', 'NULLS')""",
                "lower(name)",
                "over_cols",
            ),
            got(f"u = ')' AND n1 = 'OVER' AND m.fn IN {_in_list(K.NEEDS_ORDER)}", "named_struct('pos', pos, 'n2', n2)", "ranked"),
            got("u = 'ORDER' AND fkind = 'over'", "frame", "over_orders"),
            got(
                "name IS NOT NULL AND clause = 'WITH' AND direct AND q1 IN ('WITH', ',', 'RECURSIVE') AND n1 IN ('AS', '(')",
                "lower(name)",
                "ctes",
            ),
            got(
                f"""direct AND clause = 'SELECT' AND kind = 'word' AND pk1 = 'word' AND u NOT IN {types} AND p1 NOT IN {types}""",
                "named_struct('pos', pos, 'line', line, 'a', pt1, 'b', text)",
                "gaps",
            ),
            *[any_(cond, "t_" + rule) for rule, cond in TOKEN_FLAGS.items()],
            *[f"min(CASE WHEN {cond} THEN named_struct('pos', pos, 'x', {v}) END) AS d_{rule}" for rule, (cond, v) in TOKEN_DETAILS.items()],
            f"min(CASE WHEN ({fault_case('depth')}) IS NOT NULL THEN named_struct('pos', pos, 'kind', {fault_case('depth')}, 'line', line, 'at', at) END) AS v_fault",
            "max(named_struct('pos', pos, 'bal', depth + if(u = '(', 1, 0), 'line', line, 'at', at)) AS v_last",
            "count_if(u <> ';' AND coalesce(p1, ';') = ';') AS v_starts",
            "count_if(u = 'CASE') AS n_case",
            "count_if(u = 'ELSE') AS n_else",
            "count_if(ckw = 'SETOP' AND u = 'UNION' AND coalesce(n1, '') <> 'ALL') AS n_union",
            "count_if(ckw = 'SETOP' AND u = 'UNION' AND prev_setop.u = 'UNION' AND coalesce(prev_setop.n1, '') <> 'ALL') AS n_union_inner",
        ],
    )
    return g.selectExpr(
        *[x for x in g.columns if x not in ("n_path", "n_cols", "n_key", "has_num", "u0", "close_at")],
        "n_core IN (1, 3, 5) AND n_path = n_core AND n_cols = 1 AS bare",
        "n_key = 1 AND has_num AS ordinal",
        f"coalesce(u0 IN {_in_list(K.AGGREGATES)} AND close_at = c0 + 1, false) AS agg_item",
        "coalesce(u0 = '(' AND close_at = c0, false) AS wrapped",
    )


#: facts of a segment that every statement carries, and those that only some rules read
CARRIED = ["s", "clause", "seg", "src_no", "e", "src", "is_tab", "src_alias"]
ON_DEMAND = ["c0", "n_core", "txt", "bare", "ordinal", "agg_item", "wrapped", "star", "alias", "over_cols", "ops", *[f"j_{k}" for k in JOIN_SIDES]]


#: what a statement has, made where its text is walked
STATEMENT = ["sels", *S.GATHERED, *S.VERDICTS, "tabs"]


def statement_maker(demand: Sequence[str], wanted: Sequence[str]) -> tuple[Callable[[S.Tokens], pa.Array], str]:
    """(what makes the statements of whole texts, their type): for ``Whole.made``; the arguments are those of ``statements``."""
    segment, columns = [*CARRIED, *[k for k in ON_DEMAND if k in demand]], list(wanted)
    types = S.statement_types(segment, columns)
    return lambda t: S.statements_of(t, segment, columns), S.array_of(types)


def statements(tok: DataFrame | Whole, demand: Sequence[str] = ON_DEMAND, wanted: Sequence[str] = STATEMENT) -> DataFrame:
    """One row per statement: its SELECT arms (with their segments), columns, sources and flags.

    ``demand``: the segment facts of ``ON_DEMAND`` that are read; the optimizer cannot see into the list of segments.
    Of whole texts only the ``wanted`` columns are made, and nothing is shuffled or grouped.
    """
    if isinstance(tok, Whole):
        return tok.rows(*statement_maker(demand, wanted))
    seg = segments(tok)
    keep = [*CARRIED, *[k for k in ON_DEMAND if k in demand]]
    lists = ["cols", "aggs", "wins", "wraps", "ranked", "over_orders", "ctes", "gaps"]
    carried = [
        *[f"flatten(collect_list({x})) AS {x}" for x in lists],
        *[f"sum({x}) AS {x}" for x in ("n_case", "n_else", "n_union", "n_union_inner")],
        *[f"bool_or(t_{f}) AS t_{f}" for f in TOKEN_FLAGS],
        *[f"min(d_{f}) AS d_{f}" for f in TOKEN_DETAILS],
        "min(v_fault) AS v_fault",
        "max(v_last) AS v_last",
        "sum(v_starts) AS v_starts",
    ]
    sel = _aggregate(
        seg,
        ["tid", "stmt", "scope", "arm"],
        [
            "min(s) AS s", "max(e) AS e", "max(n_setop) AS n_setop", "bool_or(distinct) AS distinct", "bool_or(top) AS top",
            "max(opener) AS opener", "bool_or(fn_opener) AS fn_opener", "max(sub_select) AS sub_select", "bool_or(in_exists) AS in_exists",
            f"array_sort(collect_list(struct({', '.join(keep)}))) AS segs",
            *carried,
        ],
    )
    # facts of the scope, known only to its first arm
    shared = {"opener": "max", "sub_select": "max", "fn_opener": "bool_or", "n_setop": "max"}
    sel = sel.selectExpr(
        *[x for x in sel.columns if x not in shared],
        *[f"{fn}({x}) OVER (PARTITION BY tid, stmt, scope) AS {x}" for x, fn in shared.items()],
    )
    arm = "struct(scope, arm, s, e, n_setop, distinct, top, opener, fn_opener, sub_select, in_exists, segs)"
    st = _aggregate(sel, ["tid", "stmt"], [f"array_sort(collect_list({arm})) AS sels", *carried])
    return st.selectExpr(
        "*",
        """transform(flatten(transform(sels, s -> filter(s.segs, g -> g.is_tab))),
          g -> named_struct('name', g.src, 'alias', coalesce(g.src_alias, g.src), 'clause', g.clause)) AS tabs""",
    )
