"""Safe automatic fixes as edits on the token table, checked by linting the result again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from queryscope.functions import words as K
from queryscope.functions.text import BLANKS, bare, tokens
from queryscope.operators import rules as R
from queryscope.operators.findings import lint_findings, noqa_of
from queryscope.plans import tokens as T
from queryscope.session import cut

FIXES = ("x01", "x02", "x03", "x04")
_STOPS = [
    "AND", "OR", ",", ";", "THEN", "ELSE", "END", "WHEN", "GROUP", "ORDER", "HAVING", "QUALIFY", "LIMIT", "UNION",
    "INTERSECT", "EXCEPT", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "WHERE", "FROM", "AS", "ON",
]


def _edit(pos: Column, new=None, drop_ws=False, gap=False, before=None, after=None) -> Column:
    """One change at a token: other text, its white space dropped, a blank ensured, text put before or after it."""
    values = {"pos": pos.cast("int"), "new": new, "drop_ws": drop_ws, "gap": gap, "before": before, "after": after}
    kinds = {"drop_ws": "boolean", "gap": "boolean"}
    cells = [(v if isinstance(v, Column) else F.lit(v).cast(kinds.get(k, "string"))).alias(k) for k, v in values.items()]
    return F.struct(*cells)


def _null_edits(tok: DataFrame) -> DataFrame:
    """``x = NULL`` and ``NULL = x`` become IS NULL; the inequality becomes IS NOT NULL.

    An edit is refused where the operand does not end at NULL (a cast, an operator or a call follows).
    """
    c = F.col
    op = c("u").isin("=", "<>", "!=") & (c("clause") != "SET")
    test = F.when(c("u") == "=", F.lit("IS")).otherwise(F.lit("IS NOT"))
    ends = F.coalesce(c("n2").isin(*_STOPS, ")"), F.lit(True))
    right = op & (c("n1") == "NULL") & ends
    left = op & (c("p1") == "NULL") & (c("n1") != "NULL") & ~F.coalesce(c("p2").isin("IS", "NOT"), F.lit(False))
    # the operand on the right ends before the next stop word of the same frame
    back = W.partitionBy("tid", "frame").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    stop = F.max(F.when(c("u").isin(_STOPS), -c("pos"))).over(back)
    end = F.max("pos").over(W.partitionBy("tid", "frame"))
    spots = tok.withColumn("stop", -stop).withColumn("end", end).where(right | left)
    last = F.coalesce(c("stop") - 1, c("end"))
    turned = F.array(_edit(c("pos"), test, gap=True), _edit(c("pos") + 1, gap=True))
    flipped = F.array(
        _edit(c("pos") - 1, "", drop_ws=True),
        _edit(c("pos"), "", drop_ws=True),
        _edit(c("pos") + 1, gap=True),
        _edit(last, after=F.concat(F.lit(" "), test, F.lit(" NULL"))),
    )
    return spots.select("tid", F.inline(F.when(right, turned).when(last > c("pos"), flipped)))


def _distinct_spots() -> str:
    """Drop DISTINCT only if every group key is selected; otherwise it does remove rows."""
    items = R._in("s", "SELECT")
    shown = f"flatten(transform({items}, g -> array(lower(g.txt), lower(g.alias))))"
    kept = f"forall({R._in('s', 'GROUP')}, k -> k.ordinal OR coalesce(array_contains({shown}, lower(k.txt)), false))"
    spot = f"if(s.distinct AND {R._has('s', 'GROUP')} AND {kept}, array_min(transform({items}, g -> g.s)) + 1, NULL)"
    return f"array_compact(transform({R.SELECTS}, s -> {spot}))"


def _leak_spots() -> str:
    """Columns qualified by an alias that stands where a schema would."""
    bad = "filter(cols, c -> c.db IS NOT NULL AND exists(tabs, t -> lower(t.alias) = lower(c.db)))"
    return f"array_distinct(transform({bad}, c -> c.pos))"


def _statement_edits(texts: DataFrame, which: Sequence[str]) -> DataFrame:
    """Edits that whole statements decide, all from one pass over them."""
    spots = {"x02": _distinct_spots(), "x04": _leak_spots()}
    asked = {w: spots[w] for w in which if w in spots}
    st = T.statements(T.whole(texts), R.read_by(*asked.values()), R.read_columns(*asked.values()))
    st = st.selectExpr("tid", *[f"{spot} AS {w}" for w, spot in asked.items()])
    at = lambda x, back: x.cast("int") - back
    edits = {
        "x02": lambda x: F.array(_edit(x, "", drop_ws=True)),
        "x04": lambda x: F.array(_edit(at(x, 4), ""), _edit(at(x, 3), "", drop_ws=True)),
    }
    return st.select("tid", F.inline(F.flatten(F.concat(*[F.transform(w, edits[w]) for w in asked]))))


def case_spans(tok: DataFrame) -> DataFrame:
    """tid, stmt, start, end, has_else of every CASE, matched by its nesting level."""
    c = F.col
    w = W.partitionBy("tid").orderBy("pos")
    one = lambda cond: F.when(cond, 1).otherwise(0)
    level = F.sum(one(c("u") == "CASE")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.coalesce(
        F.sum(one(c("u") == "END")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    marks = tok.where(c("u").isin("CASE", "ELSE", "END")).select("tid", "stmt", "pos", "u", level.alias("lvl"))
    wl = W.partitionBy("tid", "lvl").orderBy("pos")
    before = wl.rowsBetween(W.unboundedPreceding, -1)
    return marks.select(
        "*",
        F.lag("u").over(wl).alias("prev"),
        F.last(F.when(c("u") == "CASE", c("pos")), ignorenulls=True).over(before).alias("start"),
    ).where((c("u") == "END") & (c("lvl") > 0) & c("start").isNotNull()).select(
        "tid", "stmt", "start", c("pos").alias("end"), (c("prev") == "ELSE").alias("has_else")
    )


def _case_edits(tok: DataFrame) -> DataFrame:
    return case_spans(tok).where(~F.col("has_else")).select("tid", F.inline(F.array(_edit(F.col("end"), gap=True, before=" ELSE NULL"))))


def fix_texts(texts: DataFrame, which=FIXES) -> DataFrame:
    """tid, fixed_sql for texts with at least one edit; the rest is left out.

    The text is edited in place: white space, comments, hints and all other tokens stay as they are.
    """
    c = F.col
    # a fix only walks the texts that have its word, and takes only the facts it reads from the walk
    having = lambda *words: texts.where(F.expr(" AND ".join(f"contains(upper(sql), '{w}')" for w in words)))
    parts = []
    if "x01" in which:
        parts.append(_null_edits(T.scoped_tokens(having("NULL"), ["pos", "u", "clause", "frame", "n1", "n2", "p1", "p2"])))
    if "x03" in which:
        parts.append(_case_edits(T.scoped_tokens(having("CASE", "END"), ["stmt", "pos", "u"])))
    if "x04" in which or "x02" in which:
        parts.append(_statement_edits(texts if "x04" in which else having("DISTINCT", "GROUP"), which))
    edits = reduce(DataFrame.unionByName, parts).groupBy("tid", "pos").agg(
        *[F.max(x).alias(x) for x in ("new", "before", "after")], *[F.bool_or(x).alias(x) for x in ("drop_ws", "gap")]
    )
    edits = cut(edits)  # read to choose the texts and to rewrite them
    per = edits.groupBy("tid").agg(F.collect_list(F.struct(*_EDIT)).alias("edits"))
    # every token as it stands, comments included; comments carry no position of their own
    parts = lambda r: F.struct(r.alias("raw"), (~T.is_comment(bare(r), c("dialect"))).alias("real"))
    whole = texts.select("tid", F.transform(tokens(c("sql"), c("dialect")), parts).alias("toks"), "dialect").join(per, "tid")
    rewrite = F.arrow_udf(_rewritten, "string")
    return whole.select("tid", rewrite("toks", "edits").alias("fixed_sql"))


_EDIT = ["pos", "new", "before", "after", "drop_ws", "gap"]


def _rewritten(toks: pa.Array, edits: pa.Array) -> pa.Array:
    """Per text its tokens (raw, real) with the edits at their places."""
    cuts = lambda x: [0, *np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)).tolist()]
    flat, each = toks.flatten(), edits.flatten()
    plain = lambda column: column.to_numpy(zero_copy_only=False).tolist()
    raws, real, at = plain(flat.field("raw")), plain(flat.field("real")), cuts(toks)
    values, own = list(zip(*(each.field(k).to_pylist() for k in _EDIT))), cuts(edits)
    out = []
    for t in range(len(toks)):
        by_pos = {e[0]: e[1:] for e in values[own[t] : own[t + 1]]}
        pos, pieces = 0, []
        for raw, counts in zip(raws[at[t] : at[t + 1]], real[at[t] : at[t + 1]]):
            pos += counts
            edit = by_pos.get(pos) if counts else None
            if edit is None:
                pieces.append(raw)
                continue
            new, before, after, drop_ws, gap = edit
            text = raw.lstrip(BLANKS)
            space = raw[: len(raw) - len(text)]
            pieces += [before or "", "" if drop_ws else space, " " if gap and not space else "", text if new is None else new, after or ""]
        out.append("".join(pieces))
    return pa.array(out, pa.string())


def apply_auto_fixes(log: DataFrame) -> DataFrame:
    """query_id, sql, fixed_sql, fixed_titles: titles the fix provably removed and nobody suppressed.

    Only texts with a fixable finding go through the rewrite and the second lint.
    """
    keyed = T.normalise_log(log)
    texts = T.distinct_texts(keyed)
    titles = lambda hits: F.transform(hits, lambda x: x["title"])
    # one row per text: what nobody suppressed
    orig = R.text_results(R.linted(texts, None, "sql"), None, "sql", "dialect").withColumn("noqa", noqa_of(F.col("sql"), F.col("dialect")))
    quiet = lambda x: F.coalesce("noqa.suppress_all", F.lit(False)) | F.coalesce(F.array_contains("noqa.titles", F.lower(x)), F.lit(False))
    orig = orig.select("tid", "sql", "dialect", F.filter(titles("hits"), lambda x: ~quiet(x)).alias("found"))
    todo = cut(orig.where(F.exists("found", lambda x: x.isin(K.FIXABLE)))).repartition("tid")  # shuffle texts, not their tokens
    fixed = cut(fix_texts(todo.select("tid", "sql", "dialect")).join(todo.select("tid", "dialect", "found"), "tid", "inner"))
    after = fixed.selectExpr("tid", "fixed_sql AS sql", "dialect").repartition("tid")
    left = R.text_results(R.linted(after)).where("valid").select("tid", titles("hits").alias("left"))  # never hand out a broken text
    per = fixed.join(left, "tid", "inner").select("tid", "fixed_sql", F.array_sort(F.array_except("found", "left")).alias("fixed_titles"))
    per = cut(per.where(F.size("fixed_titles") > 0))
    return keyed.select("query_id", "tid", "sql").join(per, "tid", "inner").select("query_id", "sql", "fixed_sql", "fixed_titles")


def no_new_findings(original: DataFrame, rewritten: DataFrame) -> DataFrame:
    """query_id, title of findings a rewrite introduced (both logs keyed by query_id)."""
    before = lint_findings(original).select("query_id", "title")
    after = lint_findings(rewritten).select("query_id", "title")
    return after.join(before, ["query_id", "title"], "left_anti")
