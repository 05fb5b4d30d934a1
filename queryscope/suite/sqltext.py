"""DuckDB texts of the generated query log and of what is expected from it."""

from __future__ import annotations

from collections.abc import Sequence


def lit(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return str(s)
    return "'" + str(s).replace("'", "''") + "'"


def log_sql(templates: Sequence[str]) -> str:
    """The query log as a subquery: query_id, author, ts, idx, sql."""
    texts = ", ".join(lit(t) for t in templates)
    return (
        "(SELECT o_orderkey AS query_id, o_custkey AS author, o_orderdate AS ts, "
        f"CAST(o_orderkey % {len(templates)} AS INTEGER) AS idx, "
        f"replace(list_extract([{texts}], CAST(o_orderkey % {len(templates)} AS INTEGER) + 1), '{{n}}', CAST(o_custkey AS VARCHAR)) AS sql FROM orders)"
    )


def values_sql(rows: Sequence[Sequence], cols: Sequence[str], n: int, types: dict[str, str] | None = None) -> str:
    """Expected rows per template (first column ``idx``), joined to every order of that template."""
    types = types or {}
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    shown = ", ".join(f"CAST(v.{c} AS {types[c]}) AS {c}" if c in types else f"v.{c} AS {c}" for c in cols)
    names = ", ".join(["idx", *cols])
    return f"SELECT o_orderkey AS query_id, {shown} FROM orders JOIN (VALUES {body}) v({names}) ON o_orderkey % {n} = v.idx"


def expect_sql(pairs: Sequence[tuple[str, list[str]]]) -> str:
    """(text, titles) pairs -> query_id, title."""
    rows = [(i, t) for i, (_, ts) in enumerate(pairs) for t in ts]
    return values_sql(rows, ["title"], len(pairs))
