"""Grammar faults of a token sequence by a pushdown automaton.

The stack holds open parentheses and CASE expressions; each CASE frame knows which of its parts it is in, and every frame
counts the BETWEENs that still wait for their AND. Between tokens the automaton knows whether something must follow (an
operator, a clause keyword, a separator) and rejects what cannot begin it. It errs on the side of acceptance: what some dialect reads
in another way (types in angle brackets, outer-join marks, own operators, procedural blocks) is no fault.
"""

from __future__ import annotations

#: tokens that cannot begin an expression, a name or a list
CLOSERS = frozenset([")", ",", ";", None, "=", "<>", "!=", "<=", ">=", "||", "::", "/", "FROM", "WHERE", "HAVING", "LIMIT", "UNION", "INTERSECT",
                     "THEN", "WHEN", "ELSE", "END", "AND", "OR", "AS", "ON", "JOIN", "BETWEEN", "IN", "LIKE", "ILIKE", "IS"])
NEGATED = frozenset(["BETWEEN", "IN", "LIKE", "ILIKE"])
COMPARISONS = frozenset(["=", "<>", "!=", "<=", ">=", "<"])
#: what an own operator may be made of, next to a comparison sign
OWN_OPERATOR = frozenset("@~-#|&?*%!<>^:")
#: words that need something after them, with the fault
NEEDY = {
    "WHERE": "empty condition", "HAVING": "empty condition", "QUALIFY": "empty condition", "ON": "empty condition", "AND": "empty condition", "OR": "empty condition",
    "NOT": "empty condition", "WHEN": "empty condition", "THEN": "empty branch", "ELSE": "empty branch", "LIKE": "missing operand", "ILIKE": "missing operand",
    "BETWEEN": "missing operand", "IN": "missing operand", "IS": "missing operand", "BY": "empty list", "SET": "empty list", "LIMIT": "missing operand",
    "OFFSET": "missing operand", "AS": "missing name", "INTO": "missing table", "UNION": "missing operand", "INTERSECT": "missing operand",
}
#: words that are names unless an operand stands before them
SOMETIMES_NAMES = frozenset(["LIMIT", "OFFSET", "SET"])
OPERATORS = frozenset(["+", "-", "||", "::", "/"])
#: clause words that end an expression; GROUP and ORDER with BY
ENDING = frozenset(["FROM", "WHERE", "HAVING", "QUALIFY", "LIMIT", "UNION", "INTERSECT"])
CASE, OPEN = "CASE", "("


def closes(x: str | None, n1: str | None) -> bool:
    """Can ``x`` not begin what must follow?"""
    if x in ("GROUP", "ORDER"):
        return n1 == "BY"
    if x in ("LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL"):
        return n1 in ("JOIN", "OUTER", "INNER", "LEFT", "RIGHT", "FULL")
    return x in CLOSERS


def needs(u: list[str], kind: list[str], i: int) -> str | None:
    """The fault if nothing fitting follows token ``i``."""
    x = u[i]
    p1 = u[i - 1] if i else None
    if p1 == "." or (p1 == "AS" and x != "AS"):
        return None  # a name, whatever the word
    if x in NEEDY and kind[i] != "quoted":
        if x in SOMETIMES_NAMES and not (i and (kind[i - 1] in ("word", "quoted", "num", "str") or p1 in (")", "]", "END", "NULL", "TRUE", "FALSE", "*", "ALL", "DESC", "ASC"))):
            return None if x != "SET" or i else NEEDY[x]
        return NEEDY[x]
    if x in COMPARISONS:
        return "missing operand"
    if x in OPERATORS:
        outer_mark = x == "+" and p1 == "("
        alone = x == "/" and p1 in (None, ";")
        return None if outer_mark or alone else "missing operand"
    if x == "DISTINCT" and p1 == "SELECT":
        return "empty select list"
    return None


def follows(u: list[str], i: int, fault: str) -> bool:
    """Does token ``i + 1`` fail to give what token ``i`` needs?"""
    x = u[i]
    n1 = u[i + 1] if i + 1 < len(u) else None
    n2 = u[i + 2] if i + 2 < len(u) else None
    if n1 in COMPARISONS:  # two signs side by side, unless they spell one operator
        if x in COMPARISONS:
            before = u[i - 1] if i else ""
            return (x, n1) not in (("<", "="), ("<", "<")) and before not in OWN_OPERATOR and x != "<"
        return x in NEEDY and x not in ("SET", "AS", "BY")
    if x in ("NOT", "IS") and n1 in NEGATED:
        return x == "IS"
    if (x, n1) in (("DISTINCT", "ON"), ("/", "/")):
        return False
    if x == "AS":
        return n1 in (",", ")", ";", None, "FROM", "WHERE")
    if x == "INTO":
        return n1 in (None, ";", ")", ",", "VALUES", "WHERE")
    if x in ("UNION", "INTERSECT"):
        return n1 in (None, ";", ")", ",", "WHERE", "UNION", "INTERSECT", "LIMIT") or (n1 in ("ORDER", "GROUP") and n2 == "BY")
    if x == "LIMIT" and n1 == "OFFSET":
        return True
    return closes(n1, n2)


def faults(u: list[str], kind: list[str], dialect: str) -> list[str | None]:
    """Per token the fault that it completes."""
    size = len(u)
    out: list[str | None] = [None] * size
    procedural = any(x in ("BEGIN", "DECLARE", "PROCEDURE", "FUNCTION", "TRIGGER") for x in u)
    frames: list[list] = [[OPEN, None, 0]]  # kind, part of a CASE, BETWEENs without AND

    def report(i: int, fault: str) -> None:
        if out[i] is None:
            out[i] = fault

    def close_expression(i: int) -> None:
        if frames[-1][2]:
            report(i, "BETWEEN without AND")
            frames[-1][2] = 0

    def close_cases(i: int) -> None:
        while frames[-1][0] == CASE:
            close_expression(i)
            frames.pop()
            report(i, "CASE without END")

    for i in range(size):
        x = u[i]
        p1 = u[i - 1] if i else None
        n1 = u[i + 1] if i + 1 < size else None
        fault = needs(u, kind, i)
        if fault and follows(u, i, fault):
            report(min(i + 1, size - 1), fault)
        if p1 == "." or (p1 == "AS" and x not in (OPEN, ")", ";", ",")) or kind[i] == "quoted":
            continue
        top = frames[-1]
        if x == OPEN:
            frames.append([OPEN, None, 0])
        elif x == ")":
            if p1 == OPEN and i > 1 and u[i - 2] == "IN":
                report(i, "empty list")
            close_cases(i)
            close_expression(i)
            if len(frames) > 1:
                frames.pop()
        elif x == ";":
            if not procedural:
                close_cases(i)
                close_expression(i)
                frames = [[OPEN, None, 0]]
        elif x == "BETWEEN":
            top[2] += 1
        elif x == "AND":
            top[2] = max(0, top[2] - 1)
        elif x == "OR":
            close_expression(i)
        elif x == CASE:
            if p1 != "END":
                frames.append([CASE, "CASE", 0])
        elif top[0] == CASE and x in ("WHEN", "THEN", "ELSE", "END"):
            close_expression(i)
            part = top[1]
            if x == "THEN":
                if part != "WHEN":
                    report(i, "THEN without WHEN")
            elif part == "WHEN":
                report(i, "WHEN without THEN")
            elif part == "CASE" and x != "WHEN":
                report(i, "CASE without WHEN")
            elif part == "ELSE" and x != "END":
                report(i, "branch after ELSE")
            if x == "END":
                frames.pop()
            else:
                top[1] = x
        elif x == ",":
            if not procedural:
                close_cases(i)
            close_expression(i)
        elif (x in ENDING and p1 != "DISTINCT") or (x in ("GROUP", "ORDER") and n1 == "BY"):
            close_cases(i)
            close_expression(i)
    if size and not procedural:
        if frames[-1][0] == CASE:
            close_cases(size - 1)
        close_expression(size - 1)
    return out
