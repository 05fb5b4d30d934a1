"""Text expressions: tokens, template stubs, canonical form, glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from queryscope.functions.words import DIALECTS

# What the lexers of the dialects differ in.
HASH_COMMENTS = ["bigquery", "mysql"]
BACKSLASH_ESCAPES = ["bigquery", "mysql", "snowflake", "spark"]
DOLLAR_STRINGS = ["duckdb", "postgres", "redshift", "snowflake"]
TAGGED_DOLLARS = ["duckdb", "postgres", "redshift"]
TRIPLE_QUOTES = ["bigquery"]
#: string prefixes: raw text where a backslash still guards a quote, raw text without any escape, text with escapes
RAW_PREFIX = {"bigquery": "(?:[rR][bB]?|[bB][rR]?)"}
BARE_RAW_PREFIX = {"spark": "[rR]"}
ESCAPE_PREFIX = {"duckdb": "[eE]", "postgres": "[eE]", "redshift": "[eE]"}
#: quotes with a delimiter of one's own: brackets in pairs, any other sign twice
DELIMITED_QUOTES = ["oracle"]

BLANKS = " \t\r\n\f\u000b"


def token_rx(dialect: str, possessive: bool = True) -> str:
    """One token with the white space before it; earlier alternatives win.

    Possessive quantifiers keep Java's matcher iterative on very long strings; other engines take the plain form, which has
    no back-references either and so no delimiters of one's own.
    """
    many = "*+" if possessive else "*"
    escape = r"|\\[\s\S]" if dialect in BACKSLASH_ESCAPES else ""
    inside = lambda q: f"(?:[^{q}{chr(92) * 2 if escape else ''}]|{q}{q}{escape}){many}"
    parts = [r"--[^\n]*", r"/\*[\s\S]*?\*/"]
    if dialect in HASH_COMMENTS:
        parts.append(r"#[^\n]*")
    if dialect in DOLLAR_STRINGS:
        parts.append(r"\$\$[\s\S]*?\$\$")
    if dialect in TAGGED_DOLLARS and possessive:
        parts.append(r"\$(?<tag>[\p{L}_][\p{L}\p{N}_]*)\$[\s\S]*?\$\k<tag>\$")
    if dialect in DELIMITED_QUOTES:
        pairs = [r"\[[\s\S]*?\]", r"\{[\s\S]*?\}", r"\([\s\S]*?\)", r"<[\s\S]*?>"]
        own = [r"(?<sign>[^\s\[{(<'])[\s\S]*?\k<sign>"] if possessive else []
        parts.append(f"[nN]?[qQ]'(?:{'|'.join(pairs + own)})'")
    if dialect in BARE_RAW_PREFIX:
        parts += [f"{BARE_RAW_PREFIX[dialect]}'[^']*'", f'{BARE_RAW_PREFIX[dialect]}"[^"]*"']
    if dialect in ESCAPE_PREFIX:
        parts.append(rf"{ESCAPE_PREFIX[dialect]}'(?:[^'\\]|''|\\[\s\S]){many}'")
    prefix = f"{RAW_PREFIX[dialect]}?" if dialect in RAW_PREFIX else ""
    if dialect in TRIPLE_QUOTES:
        parts += [prefix + r"\'\'\'[\s\S]*?\'\'\'", prefix + r'"""[\s\S]*?"""']
    parts += [f"{prefix}'{inside(chr(39))}'", f'{prefix}"{inside(chr(34))}"', r"`[^`]*`"]
    parts += [
        r"[\p{L}_][\p{L}\p{N}_$]*",
        r"0[xX][0-9A-Fa-f]+",
        r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?",
        r"@@?[\p{L}_][\p{L}\p{N}_$]*",
        r"\$\d+",
        r"\$\{[^}]*\}",
        r"<=>|<>|!=|<=|>=|=>|==|\|\||::|->>|->|\S",
    ]
    return rf"\s*(?:{'|'.join(parts)})"


def tokens(sql: Column, dialect: Column) -> Column:
    """Array of tokens, each with its leading white space, as the dialect's lexer cuts them."""
    by_rx: dict[str, list[str]] = {}
    for d in DIALECTS:
        by_rx.setdefault(token_rx(d), []).append(d)
    cut = lambda rx: F.regexp_extract_all(sql, F.lit(rx), F.lit(0))
    (rest, _), *others = sorted(by_rx.items(), key=lambda x: -len(x[1]))
    out = None
    for rx, names in others:
        out = F.when(dialect.isin(names), cut(rx)) if out is None else out.when(dialect.isin(names), cut(rx))
    return out.otherwise(cut(rest))


def bare(token: Column) -> Column:
    return F.ltrim(token, F.lit(BLANKS))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _swap(sql: Column, pattern: str, make) -> Column:
    """Replace every distinct match, keeping the number of line breaks."""
    found = F.array_distinct(F.regexp_extract_all(sql, F.lit(pattern), F.lit(0)))
    return F.aggregate(
        found,
        sql,
        lambda acc, m: F.replace(acc, m, F.concat(make(m), F.repeat(F.lit("\n"), newlines(m)))),
    )


def _joined_args(prefix: str):
    def make(m: Column) -> Column:
        quoted = F.regexp_extract_all(m, F.lit(r"'[^']*'|\"[^\"]*\""), F.lit(0))
        return F.concat(F.lit(prefix), F.array_join(F.transform(quoted, lambda q: F.trim(q, F.lit("'\""))), "_"))

    return make


def strip_jinja(sql: Column) -> Column:
    """Stand-ins for template constructs, in fixed order: comments, ref, source, var, other expressions, blocks."""
    arg = r"(?:'[^']*'|\"[^\"]*\")"
    call = r"\{\{\s*%s\(\s*" + arg + r"(?:\s*,\s*" + arg + r")*\s*\)\s*\}\}"
    const = lambda text: lambda m: F.lit(text)
    sql = _swap(sql, r"(?s)\{#.*?#\}", const(""))
    sql = _swap(sql, call % "ref", _joined_args("dbt_ref__"))
    sql = _swap(sql, call % "source", _joined_args("dbt_src__"))
    sql = _swap(sql, r"(?s)\{\{\s*var\(.*?\)\s*\}\}", const("'DBT_VAR'"))
    sql = _swap(sql, r"(?s)\{\{.*?\}\}", const("dbt_expr"))
    return _swap(sql, r"(?s)\{%.*?%\}", const(""))


def canonical_sql(sql: Column) -> Column:
    """Key under which cosmetically different texts meet."""
    s = F.regexp_replace(sql, r'(?i)\s+AS\s+"[^"]*"', "")
    s = F.regexp_replace(s, '["`]', "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.lower(F.regexp_replace(s, ";+$", ""))


def glob_regex(pattern: str) -> str:
    """Path glob as a regex: ``**/`` any folders or none, ``**`` anything, ``*`` and ``?`` within one segment."""
    table = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    return "^" + "".join(table.get(p) or re.escape(p) for p in parts if p) + "$"
