"""Lint rules as predicates over the statement facts.

Each rule is a column on the one-row-per-statement frame: NULL when it does not
fire, else the detail to quote. Rules that need a catalog join it. All rules of
a run are evaluated in one pass and exploded into findings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import difflib
import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from queryscope.functions import words as K
from queryscope.plans import shape as S, tokens as T

SEVERITY = {t: s for _, t, s in K.TITLES}
ORDER = {t: i for i, (_, t, _) in enumerate(K.TITLES)}
RULE_OF = {t: r for r, t, _ in K.TITLES}

#: explanation per title; ``%s`` takes the detail
MESSAGES = {
    "DELETE without WHERE": "Every row of the table is deleted. Restrict it with WHERE unless that is intended.",
    "UPDATE without WHERE": "Every row of the table is updated. Restrict it with WHERE unless that is intended.",
    "CROSS JOIN found": "All pairs of rows are produced. Use JOIN ... ON unless the product is intended.",
    "JOIN without ON condition": "Without ON or USING the join pairs every row with every row. Add the condition.",
    "SELECT * used": "All columns are read, also those nobody needs. Name the columns.",
    "LIMIT without ORDER BY": "Which rows come back is left to chance. Add ORDER BY for a stable result.",
    "LIKE starts with %": "LIKE %s cannot use an index or skip data; anchor the pattern at its start if possible.",
    "NOT IN with a subquery": "A single NULL in the subquery empties the result. Prefer NOT EXISTS.",
    "Function wrapped around a column in WHERE": "The wrapped column cannot be pruned or indexed. Compare the bare column with a constant range.",
    "UNION (not UNION ALL)": "Duplicates are removed at the price of a shuffle. Use UNION ALL where duplicates cannot occur or do not matter.",
    "HAVING used without an aggregate": "The condition filters plain rows; in WHERE it would act before grouping.",
    "Selected column missing from GROUP BY": "`%s` is neither grouped nor aggregated; engines reject it or pick an arbitrary value.",
    "ORDER BY in a subquery without LIMIT": "The outer query does not keep this order. Sort in the outermost query.",
    "CASE without ELSE": "Rows that match no branch become NULL. Spell out ELSE, even as ELSE NULL.",
    "JOIN ON true": "The condition always holds, so all pairs of rows are produced.",
    "JOIN ON 1=1": "The condition always holds, so all pairs of rows are produced.",
    "COALESCE in an equality comparison": "NULL and the fallback value become the same thing here. Treat NULL explicitly.",
    "ROW_NUMBER/LAG/LEAD without ORDER BY": "Without an order inside OVER the result may change from run to run.",
    "INSERT without a column list": "Values go by position and land in wrong columns once the table changes. List the columns.",
    "WHERE clause nullifies an outer JOIN": "`%s` is NULL for unmatched rows, so this WHERE condition drops them and the outer join becomes an inner join. Move it to ON.",
    "BETWEEN with bare date literals": "BETWEEN %s ends at midnight of the last day; later times of that day are lost. Use a half-open range.",
    "ORDER BY column position": "ORDER BY %s breaks silently when the select list changes. Sort by name.",
    "Scalar subquery without LIMIT 1": "Nothing keeps this subquery from returning several rows.",
    "UPDATE ... FROM without a join condition": "WHERE never mentions `%s`, so each target row meets every source row.",
    "Aggregate mixed with a non-grouped column": "An aggregate next to a plain column needs GROUP BY; most engines reject this.",
    "Aggregate function wraps a window function": "Aggregates cannot contain window functions. Compute the window in a subquery first.",
    "`= NULL` never matches": "A comparison with NULL is never true. Use IS NULL.",
    "`!= NULL` never matches": "A comparison with NULL is never true. Use IS NOT NULL.",
    "OFFSET without ORDER BY": "Which rows are skipped is left to chance. Add ORDER BY.",
    "Mixed ordinal and column name in GROUP BY": "Positions and names are mixed in one list. Use one style.",
    "Mixed ordinal and column name in ORDER BY": "Positions and names are mixed in one list. Use one style.",
    "Redundant DISTINCT with GROUP BY": "Grouping already yields one row per group; DISTINCT repeats the work.",
    "CTE defined but never used": "`%s` is defined but never read.",
    "Joined table never used": "No column of `%s` is used outside its own join condition.",
    "Unqualified column with multiple tables joined": "`%s` has no table name although several tables are joined.",
    "Alias referenced inside its own OVER()": "`%s` is defined by the expression that refers to it.",
    "Self-join without a distinguishing alias": "`%s` appears twice under one name. Give each occurrence its own alias.",
    "Table alias leaked into a column qualifier": "%s: the first part is a table alias of this query, not a schema.",
    "Unknown table": "%s: not in the catalog.",
    "Unknown column": "%s: not a column of that table in the catalog.",
    "Possible missing comma": "Two words stand side by side, which makes the second an alias. Is a comma missing? %s",
}

def _in(s: str, *clauses: str) -> str:
    """Segments of SELECT arm ``s`` in the given clauses."""
    names = ", ".join(f"'{c}'" for c in clauses)
    return f"filter({s}.segs, sg -> sg.clause IN ({names}))"


def _has(s: str, *clauses: str) -> str:
    names = ", ".join(f"'{c}'" for c in clauses)
    return f"exists({s}.segs, sg -> sg.clause IN ({names}))"


def _first(arr: str) -> str:
    """First entry of an array, NULL when empty."""
    return f"get({arr}, 0)"


#: SELECT arms of the statement
SELECTS = f"filter(sels, s -> s.arm >= 1 AND {_has('s', 'SELECT')})"


def _any_select(pred: str) -> str:
    """Some SELECT arm ``s`` satisfies ``pred``."""
    return f"exists({SELECTS}, s -> coalesce({pred}, false))"


def _select_detail(expr: str) -> str:
    """First non-NULL ``expr`` over the SELECT arms ``s``."""
    return _first(f"array_compact(transform({SELECTS}, s -> {expr}))")


def _cols(g: str) -> str:
    """Columns inside segment ``g``, nested sub-selects included."""
    return f"filter(cols, cl -> cl.pos BETWEEN {g}.s AND {g}.e)"


def _alias(g: str) -> str:
    return f"coalesce({g}.src_alias, {g}.src)"


SOURCES = ("FROM", "JOIN", "COMMA")
LIMITED = f"({_has('s', 'LIMIT')} OR s.top)"
ORDERED = _has("s", "ORDER")
JOINED = _in("s", "JOIN", "COMMA")
#: a derived table, scalar subquery or CTE, but no EXISTS, function argument or set operation
NESTED = "(s.scope > 0 AND s.n_setop = 0 AND s.opener NOT IN ('EXISTS', 'ANY', 'ALL', 'SOME') AND NOT s.fn_opener)"


def _ops(s: str, g: str) -> str:
    """Operators at the top level of condition ``g``; one pair of outer parentheses is looked through."""
    return f"filter({g}.ops, op -> op.frame = if({g}.wrapped, {g}.c0 + 1, {s}.scope))"


def _op(s: str, g: str, *ops: str) -> str:
    names = ", ".join(f"'{o}'" for o in ops)
    return f"exists({_ops(s, g)}, oq -> oq.u IN ({names}))"


#: WHERE conditions of ``s``; none when a top-level OR makes the whole clause one unit
CONDS = f"if(exists({_in('s', 'WHERE')}, wg -> NOT wg.wrapped AND {_op('s', 'wg', 'OR')}), filter(s.segs, wg -> false), {_in('s', 'WHERE')})"

_LITERAL = r"(\x27[^\x27]*\x27|\d+(?:\.\d+)?)"
_CALL = rf"(?i)^(?:coalesce|ifnull|nvl) \( \w+ \. \w+ , {_LITERAL} \)"
_SAFE = rf"r'{_CALL} (?:([+-]) (\d+(?:\.\d+)?) )?(=|<>|!=|<|>|<=|>=) {_LITERAL}$'"
_SAFE_IN = rf"r'{_CALL} (NOT )?IN \( (.*) \)$'"
#: a CASE with a branch for NULL is not judged
_NULL_BRANCH = r"r'(?i)\bcase\b.*\bis null\b.*\bend\b'"


def _null_safe(txt: str) -> str:
    """Is a condition on a column with a fallback for NULL true for a row whose columns are all NULL?

    Forms: ``COALESCE(col, a) op b``, ``COALESCE(col, a) + c op b``, ``COALESCE(col, a) [NOT] IN (...)`` with literals, and
    a CASE that has a branch for NULL.
    """
    a, sign, step, op, b = (f"regexp_extract({txt}, {_SAFE}, {i})" for i in range(1, 6))

    def cmp(l: str, r: str) -> str:
        return (
            f"CASE {op} WHEN '=' THEN {l} = {r} WHEN '<>' THEN {l} <> {r} WHEN '!=' THEN {l} <> {r} WHEN '<' THEN {l} < {r}"
            f" WHEN '>' THEN {l} > {r} WHEN '<=' THEN {l} <= {r} ELSE {l} >= {r} END"
        )

    number = f"(try_cast({a} AS DOUBLE) + CASE {sign} WHEN '+' THEN try_cast({step} AS DOUBLE) WHEN '-' THEN -try_cast({step} AS DOUBLE) ELSE 0D END)"
    nums = f"try_cast({a} AS DOUBLE) IS NOT NULL AND try_cast({b} AS DOUBLE) IS NOT NULL"
    plain = f"({op} <> '' AND if({nums}, {cmp(number, f'try_cast({b} AS DOUBLE)')}, {sign} = '' AND {cmp(a, b)}))"
    value, negated, listed = (f"regexp_extract({txt}, {_SAFE_IN}, {i})" for i in range(1, 4))
    inside = f"({value} <> '' AND array_contains(split({listed}, ' , '), {value}) = ({negated} = ''))"
    return f"({plain} OR {inside} OR {txt} RLIKE {_NULL_BRANCH})"


def _nullified() -> str:
    """First optional-side column that a WHERE condition filters on."""
    main = _alias(_first(_in("s", "FROM")))
    optional = f"""array_compact(flatten(transform({JOINED}, j -> CASE WHEN j.j_left THEN array({_alias('j')}) WHEN j.j_right THEN array({main})
      WHEN j.j_full THEN array({_alias('j')}, {main}) ELSE CAST(array() AS array<string>) END)))"""
    not_null = f"exists({_ops('s', 'g')}, oq -> oq.u = 'IS' AND oq.n1 = 'NOT')"
    guarded = f"flatten(transform(filter({CONDS}, g -> {not_null}), g -> transform({_cols('g')}, cq -> cq.qual)))"
    # a condition that holds for a row of NULLs lets unmatched rows through
    found = f"""flatten(transform(filter({CONDS}, g -> NOT {_op('s', 'g', 'OR', 'IS')} AND NOT coalesce({_null_safe('g.txt')}, false)),
      g -> filter({_cols('g')}, cq -> cq.qual IS NOT NULL AND NOT coalesce(array_contains({guarded}, cq.qual), false)
        AND array_contains({optional}, cq.qual))))"""
    outer = f"exists({JOINED}, j -> j.j_left OR j.j_right OR j.j_full)"
    return f"CASE WHEN {outer} THEN {_first(f'transform({found}, x -> concat_ws({chr(39)}.{chr(39)}, x.qual, x.name))')} END"


def _tautology(test: str) -> str:
    """A join whose whole ON is the given test on its text ``o.txt``."""
    on = "filter(s.segs, h -> h.clause = 'ON' AND h.src_no = j.src_no)"
    return f"exists(sels, s -> exists({JOINED}, j -> size({on}) = 1 AND exists({on}, o -> {test})))"


def _unused_join() -> str:
    zone = "(g.clause IN ('SELECT', 'WHERE', 'GROUP', 'HAVING', 'ORDER') OR (g.clause = 'ON' AND g.src_no <> j.src_no))"
    used = f"exists(filter(s.segs, g -> {zone}), g -> exists({_cols('g')}, cq -> coalesce(cq.qual = {_alias('j')}, false)))"
    # table functions such as UNNEST are not judged
    idle = f"filter({JOINED}, j -> {_alias('j')} IS NOT NULL AND (j.is_tab OR j.src IS NULL) AND NOT {used})"
    return f"if({_has('s', 'FROM')}, {_alias(_first(idle))}, NULL)"


def _ambiguous() -> str:
    ok = f"size({JOINED}) >= 1 AND {_has('s', 'FROM')} AND forall({_in('s', *SOURCES)}, g -> g.is_tab)"
    loose = f"flatten(transform({_in('s', 'SELECT')}, g -> filter({_cols('g')}, cq -> cq.qual IS NULL AND cq.name <> '*')))"
    return f"if({ok}, {_first(loose)}.name, NULL)"


def _ungrouped() -> str:
    keys = f"transform({_in('s', 'GROUP')}, k -> lower(k.txt))"
    bad = f"filter({_in('s', 'SELECT')}, g -> g.bare AND NOT array_contains({keys}, lower(g.txt)))"
    return f"if({_has('s', 'GROUP')}, replace({_first(bad)}.txt, ' ', ''), NULL)"


def _mixed_agg() -> str:
    own = lambda x: f"{x}.scope = s.scope AND {x}.arm = s.arm AND {x}.clause = 'SELECT'"
    inside = lambda x: f"exists(wins, w -> {x}.pos BETWEEN w.o - 1 AND w.z)"
    agg = f"exists(aggs, a -> {own('a')} AND NOT a.in_over AND NOT {inside('a')})"
    col = f"exists(cols, c -> {own('c')} AND c.plain AND NOT {inside('c')})"
    return f"NOT {_has('s', 'GROUP')} AND {agg} AND {col}"


def _own_over() -> str:
    bad = f"filter({_in('s', 'SELECT')}, g -> g.alias IS NOT NULL AND array_contains(g.over_cols, lower(g.alias)))"
    return f"{_first(bad)}.alias"


def _same_alias() -> str:
    srcs = f"filter({_in('s', *SOURCES)}, g -> g.is_tab)"
    keys = f"transform({srcs}, g -> concat_ws('\\n', lower(g.src), lower({_alias('g')})))"
    return f"if(size(array_distinct({keys})) < size({keys}), {_first(srcs)}.src, NULL)"


def _unlinked_update() -> str:
    names = f"transform({_in('s', *SOURCES)}, g -> {_alias('g')})"
    quals = f"array_compact(flatten(transform({_in('s', 'WHERE')}, g -> transform({_cols('g')}, cq -> cq.qual))))"
    ok = f"{_has('s', 'UPDATE')} AND {_has('s', 'FROM')} AND {_has('s', 'WHERE')} AND size({names}) > 0"
    return _first(f"array_compact(transform(sels, s -> if({ok} AND NOT coalesce(arrays_overlap({names}, {quals}), false), {_first(names)}, NULL)))")


def correlation_risk() -> str:
    """Sub-select mixing an equality correlation with another correlated condition, outside EXISTS."""
    own = f"transform({_in('s', *SOURCES)}, w -> {_alias('w')})"
    outer = f"exists({_cols('g')}, cq -> cq.qual IS NOT NULL AND NOT coalesce(array_contains({own}, cq.qual), false))"
    eq = lambda g: f"({_op('s', g, '=')} AND NOT {_op('s', g, 'OR', 'IN', 'IS', 'LIKE', 'BETWEEN')})"
    corr = f"filter({CONDS}, g -> {outer})"
    return _any_select(
        f"s.scope > 0 AND NOT s.in_exists AND size({own}) > 0 AND exists({corr}, x -> {eq('x')}) AND exists({corr}, x -> NOT {eq('x')})"
    )


def _leaks() -> str:
    names = "transform(tabs, t -> lower(t.alias))"
    bad = f"filter(cols, c -> c.db IS NOT NULL AND array_contains({names}, lower(c.db)))"
    shown = f"array_distinct(transform(array_sort({bad}), c -> concat('`', c.db, '.', c.qual, '.', c.name, '`')))"
    return f"if(size({bad}) > 0, array_join({shown}, ', '), NULL)"


def _gap_list() -> str:
    shown = "transform(slice(array_sort(gaps), 1, 8), h -> concat('line ', h.line, ': `', h.a, '` → `', h.b, '`'))"
    more = "if(size(gaps) > 8, concat(' (+', size(gaps) - 8, ' more)'), '')"
    return f"if(size(gaps) > 0, concat(array_join({shown}, '; '), {more}), NULL)"


def _when(cond: str) -> str:
    return f"if(coalesce({cond}, false), '', NULL)"


def _mixed(clause: str) -> str:
    items = _in("s", clause)
    return _when(_any_select(f"exists({items}, g -> g.ordinal) AND exists({items}, g -> NOT g.ordinal)"))


def _unless_where(head: str) -> str:
    return _when(f"exists(sels, s -> {_has('s', head)} AND NOT {_has('s', 'WHERE')})")


def rule_columns() -> dict[str, str]:
    """Title -> SQL expression of the detail (NULL = clean)."""
    condition_of = "exists(s.segs, h -> h.clause IN ('ON', 'USING') AND h.src_no = j.src_no)"
    offset = f"({_has('s', 'OFFSET')} OR exists({_in('s', 'LIMIT')}, g -> contains(g.txt, ' , ')))"
    agg_inside = f"exists({_in('s', 'HAVING')}, g -> exists(aggs, a -> a.pos BETWEEN g.s AND g.e))"
    one_agg = f"exists({_in('s', 'SELECT')}, g -> g.agg_item)"
    wrapped = "exists(wraps, w -> exists(cols, c -> c.in_where AND c.pos BETWEEN w.o AND w.z))"
    literal = r"o.txt RLIKE r'^(\x27[^\x27]*\x27|\d+(?:\.\d+)?) = \1$'"
    ordinal = f"substring_index({_first('filter(' + _in('s', 'ORDER') + ', g -> g.ordinal)')}.txt, ' ', 1)"
    return {
        "DELETE without WHERE": _unless_where("DELETE"),
        "UPDATE without WHERE": _unless_where("UPDATE"),
        "CROSS JOIN found": _when(f"exists(sels, s -> exists({JOINED}, j -> j.j_cross))"),
        "JOIN without ON condition": _when(f"exists(sels, s -> exists({JOINED}, j -> NOT j.j_cross AND NOT {condition_of}))"),
        "SELECT * used": _when(_any_select(f"exists({_in('s', 'SELECT')}, g -> g.star)")),
        "LIMIT without ORDER BY": _when(_any_select(f"{LIMITED} AND NOT {ORDERED}")),
        "LIKE starts with %": "d_l06.x",
        "NOT IN with a subquery": _when("t_l07"),
        "Function wrapped around a column in WHERE": _when(f"t_l08cast OR {wrapped}"),
        "UNION (not UNION ALL)": _when("n_union > n_union_inner"),
        "HAVING used without an aggregate": _when(_any_select(f"{_has('s', 'HAVING')} AND NOT {agg_inside}")),
        "Selected column missing from GROUP BY": _select_detail(_ungrouped()),
        "ORDER BY in a subquery without LIMIT": _when(_any_select(f"{NESTED} AND {ORDERED} AND NOT {LIMITED}")),
        "CASE without ELSE": _when("n_case > n_else"),
        "JOIN ON true": _when(_tautology("lower(o.txt) = 'true'")),
        "JOIN ON 1=1": _when(_tautology(literal)),
        "COALESCE in an equality comparison": _when("t_l15"),
        "ROW_NUMBER/LAG/LEAD without ORDER BY": _when(
            "exists(ranked, r -> coalesce(r.n2, '') <> '(' OR NOT array_contains(over_orders, r.pos + 3))"
        ),
        "INSERT without a column list": _when("t_l17"),
        "WHERE clause nullifies an outer JOIN": _select_detail(_nullified()),
        "BETWEEN with bare date literals": "d_l19.x",
        "ORDER BY column position": _select_detail(ordinal),
        "Scalar subquery without LIMIT 1": _when(
            _any_select(f"{NESTED} AND s.sub_select > 0 AND NOT {LIMITED} AND NOT ({one_agg} AND NOT {_has('s', 'GROUP')})")
        ),
        "UPDATE ... FROM without a join condition": _unlinked_update(),
        "Aggregate mixed with a non-grouped column": _when(_any_select(_mixed_agg())),
        "Aggregate function wraps a window function": _when("t_l24"),
        "`= NULL` never matches": _when("t_l25eq"),
        "`!= NULL` never matches": _when("t_l25ne"),
        "OFFSET without ORDER BY": _when(_any_select(f"{offset} AND NOT {ORDERED}")),
        "Mixed ordinal and column name in GROUP BY": _mixed("GROUP"),
        "Mixed ordinal and column name in ORDER BY": _mixed("ORDER"),
        "Redundant DISTINCT with GROUP BY": _when(_any_select(f"s.distinct AND {_has('s', 'GROUP')}")),
        "CTE defined but never used": _first("filter(ctes, n -> NOT exists(tabs, t -> lower(t.name) = n))"),
        "Joined table never used": _select_detail(_unused_join()),
        "Unqualified column with multiple tables joined": _select_detail(_ambiguous()),
        "Alias referenced inside its own OVER()": _select_detail(_own_over()),
        "Self-join without a distinguishing alias": _select_detail(_same_alias()),
        "Table alias leaked into a column qualifier": _leaks(),
        "Possible missing comma": _gap_list(),
    }


# ---- validity and hints -----------------------------------------------------

STARTER_RX = r"^\s*([A-Za-z_]+)"


def validity(texts: DataFrame) -> DataFrame:
    """tid, valid, kind, line, adj, statement_count, form (printed on one line).

    A stand-in for a grammar check: the automaton of ``plans.grammar`` and token neighbours.
    """
    row = ", ".join(f"{k}:{v}" for k, v in S.VALIDITY.items())
    g = T.whole(texts).made(S.validity_of, f"struct<{row}>").where("found IS NOT NULL").select("tid", "found.*")
    open_ = "f IS NULL AND z.bal <> 0"
    return g.selectExpr(
        "tid",
        "f IS NULL AND z.bal = 0 AS valid",
        f"if({open_}, 'unbalanced parentheses', f.kind) AS kind",
        f"if({open_}, z.line, f.line) AS line",
        "adj",
        "statement_count",
        "form",
    )


@functools.lru_cache(maxsize=65536)
def _nearest(word: str) -> str | None:
    return next(iter(difflib.get_close_matches(word, K.STARTERS, n=1, cutoff=0.7)), None)


def nearest_starter() -> Callable[[Column], Column]:
    """The starter nearest to an unknown first word (similarity at least 0.7, best one); each word is judged once per worker."""
    near = _nearest

    @F.pandas_udf("string")
    def close(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else near(x))

    return close


def with_hint(checked: DataFrame) -> DataFrame:
    """The rows (sql, valid, line, adj) with hint_kind and hint of invalid texts: typo of a keyword, else parentheses, else neighbouring values."""
    c = F.col
    bad = ~F.coalesce(c("valid"), F.lit(True))
    word = F.regexp_extract("sql", STARTER_RX, 1)
    unknown = bad & (word != "") & ~F.lower(word).isin(K.STARTERS)
    checked = checked.withColumn("suggestion", nearest_starter()(F.when(unknown, F.lower(word))))
    opens = F.length("sql") - F.length(F.replace("sql", F.lit("("), F.lit("")))
    closes = F.length("sql") - F.length(F.replace("sql", F.lit(")"), F.lit("")))
    typo = F.concat(F.lit("No statement starts with '"), word, F.lit("'. The nearest keyword is "), F.upper("suggestion"), F.lit("."))
    side = F.when(opens > closes, "closing").otherwise("opening")
    parens = F.concat(F.lit("The text opens "), opens, F.lit(" and closes "), closes, F.lit(" parentheses; check for a lost "), side, F.lit(" one."))
    adj = F.concat(F.lit("`"), c("adj.a"), F.lit("` and `"), c("adj.b"), F.lit("` touch on line "), c("adj.line"), F.lit("; an operator or comma seems to be lost there."))
    kind = F.when(c("suggestion").isNotNull(), "typo").when(opens != closes, "parentheses").when(c("adj").isNotNull(), "adjacent")
    hint = F.when(c("suggestion").isNotNull(), typo).when(opens != closes, parens).otherwise(adj)
    return checked.withColumn("hint_kind", F.when(bad, kind)).withColumn("hint", F.when(bad, hint)).drop("suggestion")


def hints(texts: DataFrame, checked: DataFrame) -> DataFrame:
    """One hint per invalid text: typo of a keyword, else parentheses, else neighbouring values."""
    bad = texts.join(checked.where(~F.col("valid")), "tid", "inner")
    return with_hint(bad).select("tid", "kind", "line", "hint_kind", "hint")


# ---- catalog rules ----------------------------------------------------------


def table_refs(st: DataFrame) -> DataFrame:
    """tid, stmt, table_name, alias of every table reference that is not a CTE of the statement."""
    t = st.selectExpr("tid", "stmt", "ctes", "inline(tabs)")
    return t.where("NOT array_contains(ctes, lower(name))").selectExpr("tid", "stmt", "lower(name) AS table_name", "alias")


def column_refs(st: DataFrame) -> DataFrame:
    """tid, stmt, alias, column and the table the alias stands for (the last table under that alias wins)."""
    of_alias = "try_element_at(filter(tabs, t -> t.alias = c.qual), -1).name"
    only = "array_distinct(transform(tabs, t -> lower(t.name)))"
    table = f"lower(CASE WHEN c.qual IS NOT NULL THEN {of_alias} WHEN size({only}) = 1 THEN get({only}, 0) END)"
    cols = f"transform(filter(cols, c -> c.name <> '*'), c -> named_struct('alias', c.qual, 'column_name', c.name, 'table_name', {table}))"
    return st.selectExpr("tid", "stmt", f"inline({cols})")


def unknown_tables(st: DataFrame, catalog: DataFrame) -> DataFrame:
    """tid, title, detail for table names that are not in the catalog."""
    known = catalog.selectExpr("lower(table_name) AS table_name").distinct()
    miss = table_refs(st).join(known, "table_name", "left_anti")
    return miss.groupBy("tid").agg(F.expr(_listed("table_name"))).withColumn("title", F.lit("Unknown table"))


def unknown_columns(st: DataFrame, catalog: DataFrame) -> DataFrame:
    """tid, title, detail for qualified columns that a known table does not have."""
    low = catalog.selectExpr("lower(table_name) AS table_name", "lower(column_name) AS _col").distinct()
    refs = column_refs(st).where("alias IS NOT NULL AND table_name IS NOT NULL").selectExpr("*", "lower(column_name) AS _col")
    in_catalog = refs.join(low.select("table_name").distinct(), "table_name", "left_semi")
    miss = in_catalog.join(low, ["table_name", "_col"], "left_anti")
    return miss.groupBy("tid").agg(F.expr(_listed("concat_ws('.', alias, column_name)"))).withColumn("title", F.lit("Unknown column"))


def _listed(name: str) -> str:
    return f"array_join(transform(array_sort(collect_set({name})), n -> concat('`', n, '`')), ', ') AS detail"


# ---- the lint job -----------------------------------------------------------

_EXTRA: dict[str, tuple[str, str, str]] = {}


def register_rule(title: str, severity: str, message: str, detail: str) -> None:
    """Add a rule of your own: ``detail`` is a SQL expression over the statement facts, NULL when clean."""
    if severity not in K.SEVERITY_RANK:
        raise ValueError(f"unknown severity {severity}")
    _EXTRA[title] = (severity, message, detail)


def unregister_rule(title: str) -> None:
    _EXTRA.pop(title, None)


def _chosen(titles: Sequence[str] | None) -> dict[str, tuple[str, str, str]]:
    """Title -> (severity, message, detail expression) of the rules asked for, own ones included."""
    rules = {t: (SEVERITY[t], MESSAGES[t], d) for t, d in rule_columns().items()}
    rules.update(_EXTRA)
    return {t: r for t, r in rules.items() if titles is None or t in titles}


def read_columns(*details: str) -> list[str]:
    """The columns of a statement that SQL expressions over its facts read."""
    words = set(re.findall(r"\w+", " ".join(details)))
    return [k for k in T.STATEMENT if k in words]


def read_by(*details: str) -> list[str]:
    """The segment facts on demand that SQL expressions over the statement facts read."""
    words = set(re.findall(r"\w+", " ".join(details)))
    return [k for k in T.ON_DEMAND if k in words]


def demanded(titles: Sequence[str] | None) -> list[str]:
    """The segment facts that the rules asked for read."""
    return read_by(*[d for _, _, d in _chosen(titles).values()])


def linted(texts: DataFrame, titles: Sequence[str] | None = None, *keep: str) -> DataFrame:
    """tid, the columns to ``keep``, found: the statements of each text as one array, with what the rules asked for and the verdict read."""
    read = [*dict.fromkeys([*read_columns(*[d for _, _, d in _chosen(titles).values()]), "v_fault", "v_last", "v_starts", "v_adjacent"])]
    return T.whole(texts).made(*T.statement_maker(demanded(titles), read), *keep)


_WORD = re.compile(r"""r?'(?:[^'\\]|\\.)*'|r?"(?:[^"\\]|\\.)*"|[\w.]+""")


def _of_entry(detail: str, entry: str) -> str:
    """A SQL expression over statement facts, read from ``entry``: names in literals, fields and variables of its own stay as they are."""
    own = set(re.findall(r"(\w+)\s*->", detail)) | {v for vs in re.findall(r"\(([\w\s,]+)\)\s*->", detail) for v in re.findall(r"\w+", vs)}
    facts = {"stmt", *T.STATEMENT}
    if own & facts:  # a variable hides a fact: the facts are bound to their names instead
        for name in sorted(facts & set(re.findall(r"\w+", detail)), reverse=True):
            detail = f"get(transform(array({entry}.{name}), {name} -> {detail}), 0)"
        return detail
    return _WORD.sub(lambda m: f"{entry}.{m[0]}" if m[0].split(".")[0] in facts else m[0], detail)


def _hits(rules: dict[str, tuple[str, str, str]]) -> str:
    """Array of the rules that fire on a statement."""
    entries = [
        f"named_struct('rule_no', {ORDER.get(t, 1000 + i)}, 'severity', '{sev}', 'title', {_quote(t)}, 'detail', CAST({d} AS STRING))"
        for i, (t, (sev, _, d)) in enumerate(rules.items())
    ] or ["named_struct('rule_no', 0, 'severity', '', 'title', '', 'detail', CAST(NULL AS STRING))"]
    return f"filter(array({', '.join(entries)}), x -> x.detail IS NOT NULL)"


def _once(expr: str) -> str:
    """An expression that the optimizer leaves where it stands: a filter on it would evaluate all rules a second time below."""
    return f"if(spark_partition_id() >= 0, {expr}, NULL)"


def text_results(linted: DataFrame, titles: Sequence[str] | None = None, *keep: str) -> DataFrame:
    """tid, the columns to ``keep``, hits (one per title, from the first statement that fires), valid, kind, line, at (offset of the fault), statement_count, adj (values side by side).

    ``linted``: the statements of each text as an array, as ``linted`` gives them. Text by text, nothing is shuffled.
    """
    rules = {t: (sev, m, _of_entry(d, "st_")) for t, (sev, m, d) in _chosen(titles).items()}
    known = ", ".join(f"{_quote(t)}, {_quote(m)}" for t, (_, m, _) in rules.items()) or "'', ''"
    by_title = f"transform({_hits(rules)}, x -> struct(x.title AS title, st_.stmt AS stmt, x.rule_no AS rule_no, x.severity AS severity, x.detail AS detail))"
    all_hits = f"array_sort(flatten(transform(found, st_ -> {by_title})))"
    g = linted.selectExpr(
        "tid",
        *keep,
        f"{_once(all_hits)} AS a",
        "array_min(transform(found, st_ -> st_.v_fault)) AS f",
        "array_max(transform(found, st_ -> st_.v_last)) AS z",
        "array_min(transform(found, st_ -> st_.v_adjacent)) AS adj",
        "CAST(aggregate(found, 0L, (n, st_) -> n + st_.v_starts) AS INT) AS statement_count",
    )
    first = "filter(a, (x, i) -> i = 0 OR x.title <> get(a, i - 1).title)"
    shown = f"replace(try_element_at(map({known}), x.title), '%s', x.detail)"
    open_ = "f IS NULL AND z.bal <> 0"
    return g.selectExpr(
        "tid",
        *keep,
        f"transform({first}, x -> struct(x.rule_no AS rule_no, x.severity AS severity, x.title AS title, {shown} AS message)) AS hits",
        "f IS NULL AND z.bal = 0 AS valid",
        f"if({open_}, 'unbalanced parentheses', f.kind) AS kind",
        f"if({open_}, z.line, f.line) AS line",
        f"if({open_}, z.at, f.at) AS at",
        "statement_count",
        "adj",
    )


def catalog_findings(st: DataFrame, catalog: DataFrame, titles: Sequence[str] | None = None) -> DataFrame | None:
    """tid, more (array of hits) for names that the catalog does not have."""
    found = None
    for t, fn in (("Unknown table", unknown_tables), ("Unknown column", unknown_columns)):
        if titles is None or t in titles:
            message = f"replace({_quote(MESSAGES[t])}, '%s', detail)"
            f = fn(st, catalog).selectExpr("tid", f"struct({ORDER[t]} AS rule_no, '{SEVERITY[t]}' AS severity, title, {message} AS message) AS h")
            found = f if found is None else found.unionByName(f)
    return None if found is None else found.groupBy("tid").agg(F.collect_list("h").alias("more"))


def text_findings(st: DataFrame, titles: Sequence[str] | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """tid, rule_no, severity, title, message: one finding per text and title."""
    rules = _chosen(titles)
    messages = {t: m for t, (_, m, _) in rules.items()}
    hits = None
    if rules:
        hits = st.selectExpr("tid", "stmt", f"explode({_hits(rules)}) AS h")
        # the first statement that fires supplies the message
        hits = hits.groupBy("tid", "h.title").agg(F.expr("min_by(h, stmt) AS h")).selectExpr(
            "tid", "h.rule_no", "h.severity", "h.title", "h.detail"
        )
    if catalog is not None:
        for t, fn in (("Unknown table", unknown_tables), ("Unknown column", unknown_columns)):
            if titles is None or t in titles:
                messages[t] = MESSAGES[t]
                f = fn(st, catalog).selectExpr("tid", f"{ORDER[t]} AS rule_no", f"'{SEVERITY[t]}' AS severity", "title", "detail")
                hits = f if hits is None else hits.unionByName(f)
    known = ", ".join(f"{_quote(t)}, {_quote(m)}" for t, m in messages.items())
    return hits.selectExpr("tid", "rule_no", "severity", "title", f"replace(try_element_at(map({known}), title), '%s', detail) AS message")


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def titles_of(*rules: str) -> list[str]:
    return [t for r, t, _ in K.TITLES if r in rules]
