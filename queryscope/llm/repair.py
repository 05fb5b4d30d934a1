"""Repair of conversation structure by a generalised LR parser.

Roles must read ``s?(ua)+`` or nothing (system, user, assistant by their initials). An LR automaton of that grammar is run
over the turns with weighted edits: keep, delete, rerole, insert. Its graph-structured stack holds one stack per top state:
stacks with equal tops accept the same continuations, so they are merged by the minimum of (cost, audit). The audit is
the string of the edits' initials. Audits that meet at a top after the same number of turns are never prefixes of each other
(equal costs exclude extra inserts), so a rank stands for each and a step costs the same at any length.

Conversations are range-partitioned by (conversation, turn). One that lies within a task is repaired there. One that spans
tasks, or has more than ``PART_ROWS`` turns or ``PART_BYTES`` of text, is cut into parts: each part tells what every entry stack
leads to, the few numbers of the parts are chained, and each part is then repaired from the stack it is entered with. So a
conversation with a third of all rows uses many tasks and no task holds more than a part of it.

Defined cases: a null role or text is one space; turns are ordered with null first, equal turns by role and MD5 of the text;
a null conversation id is a conversation of its own; the first character of a role is its initial, so an empty or unknown role is kept by no
parse; repeated rows are duplicates; a conversation that the damage empties has no parts; an empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from queryscope.llm.common import stored, type_of

#: a conversation is cut into parts beyond this many turns or bytes of text
PART_ROWS, PART_BYTES = 50_000, 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": b"user", "a": b"assistant"}
SPACE = " \t\n\x0b\f\r"

# LR automaton of  S -> (nothing) | T | s T ;  T -> P | T P ;  P -> u a
SHIFT = {(0, "s"): 1, (0, "u"): 5, (1, "u"): 5, (2, "u"): 5, (3, "u"): 5, (5, "a"): 6}
GOTO = {(0, "P"): 4, (1, "P"): 4, (2, "P"): 7, (3, "P"): 7, (0, "T"): 3, (1, "T"): 2}
REDUCE = {6: ("P", 2), 4: ("T", 1), 7: ("T", 2)}
ACCEPT = (0, 2, 3)
START = (0,)
Stack = tuple[int, ...]


@lru_cache(None)
def advance(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a symbol was shifted and everything was reduced; None if the symbol is no continuation."""
    to = SHIFT.get((stack[-1], symbol))
    if to is None:
        return None
    stack = (*stack, to)
    while stack[-1] in REDUCE:
        name, size = REDUCE[stack[-1]]
        below = stack[:-size]
        stack = (*below, GOTO[below[-1], name])
    return stack


def reachable() -> list[Stack]:
    """All stacks that a parse can stand on between two turns."""
    found, todo = {START}, [START]
    while todo:
        for symbol in "sua":
            if (new := advance(todo[0], symbol)) and new not in found:
                found.add(new)
                todo.append(new)
        todo = todo[1:]
    return sorted(found)


#: one stack per top: (stack, cost above the least, rank of its audit)
Front = tuple[tuple[Stack, int, int], ...]


def _merge(best: dict, stack: Stack, cost: int, audit: tuple[int, str]) -> bool:
    old = best.get(stack[-1])
    if old is None or (cost, audit) < old[1:]:
        best[stack[-1]] = (stack, cost, audit)
        return True
    return False


def _with_inserts(front: Front) -> dict:
    """Tops after any inserts: top -> (stack, cost, (rank, added edits))."""
    best: dict = {}
    for stack, cost, rank in front:
        _merge(best, stack, cost, (rank, ""))
    changed = True
    while changed:
        changed = False
        for stack, cost, (rank, added) in list(best.values()):
            for symbol in ROLES:
                if new := advance(stack, symbol):
                    changed |= _merge(best, new, cost + INSERT, (rank, added + "I"))
    return best


@lru_cache(1 << 16)
def step(front: Front, initial: str, must_go: bool, truncated: bool) -> tuple[Front, int, tuple]:
    """The front after one turn, what the least cost rose by, and per top of it: (rank it came from, edits added)."""
    best: dict = {}
    for stack, cost, (rank, added) in _with_inserts(front).values():
        _merge(best, stack, cost + DELETE, (rank, added + "D"))
        if not must_go:
            extra = TRUNCATED if truncated else 0
            if new := advance(stack, initial):
                _merge(best, new, cost + KEEP + extra, (rank, added + "K"))
            for symbol in ROLES:
                if new := advance(stack, symbol):
                    _merge(best, new, cost + REROLE + extra, (rank, added + "R"))
    least = min(cost for _, cost, _ in best.values())
    ranks = {audit: k for k, audit in enumerate(sorted(audit for _, _, audit in best.values()))}
    tops = sorted(best.values(), key=lambda x: x[2])
    return tuple((stack, cost - least, ranks[audit]) for stack, cost, audit in tops), least, tuple(audit for _, _, audit in tops)


def accept(front: Front) -> tuple[int, int, str]:
    """(cost, rank, inserts) of the best end of a conversation."""
    ends = [(cost, *audit) for stack, cost, audit in _with_inserts(front).values() if stack[-1] in ACCEPT]
    return min(ends)


def parse(kinds: list[tuple[str, bool, bool]], start: Stack = START) -> tuple[Front, int, list[tuple]]:
    """Front after turns (initial, must go, truncated), the least cost, and for each turn where its tops came from."""
    front, total, back = ((start, 0, 0),), 0, []
    for kind in kinds:
        front, rise, came = step(front, *kind)
        total += rise
        back.append(came)
    return front, total, back


def audit_of(back: list[tuple], rank: int) -> str:
    """Edits of the audit with a rank after the last turn."""
    out = []
    for came in reversed(back):
        rank, added = came[rank]
        out.append(added)
    return "".join(reversed(out))


def apply(audit: str, turns: list[tuple[bytes, bytes, str]], stack: Stack = START) -> list[tuple[bytes, bytes]]:
    """The repaired (role, text) of turns (role, text, initial)."""
    out, k = [], 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        if edit == "K":
            role, text, symbol = turns[k]
        else:
            symbol = next(x for x in ROLES if advance(stack, x))
            role, text = ROLES[symbol], b"" if edit == "I" else turns[k][1]
        k += edit != "I"
        stack = advance(stack, symbol)
        out.append((role, text))
    return out


def text_or_space(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by a checksum of the conversation and the turn."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text_or_space("role").alias("role"), text_or_space("text").alias("text"), draw.alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns with what a repair needs to know of each, range-partitioned and sorted by conversation and turn."""
    role, text = text_or_space("role"), text_or_space("text")
    end = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    rows = rows.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").alias("turn"),
        role.cast("binary").alias("role"),
        text.cast("binary").alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.substring(role, 1, 1).alias("initial"),
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("cut"),
        # equal rows stand for each other; the number only lets range borders fall between them
        F.monotonically_increasing_id().alias("_u"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("_u")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_u")


TURN = ["turn", "role", "text", "digest", "initial", "blank", "cut"]
TURNS = "array<struct<role:binary,text:binary>>"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _whole(rows: list[tuple]) -> dict:
    """A conversation that lies in one task: its numbers, audit and repaired turns."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, _, digest, initial, blank, cut in rows:
        fault = "blank" if blank else "duplicate" if digest in seen else "truncated" if cut else None
        seen.add(digest)
        if fault:
            counts[fault] += 1
        kinds.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
    front, total, back = parse(kinds)
    cost, rank, added = accept(front)
    audit = audit_of(back, rank) + added
    repaired = apply(audit, [(r[1], r[2], r[4]) for r in rows])
    return {**counts, "gaps": _gaps([r[0] for r in rows]), "illegal": _illegal([r[4] for r in rows]), "cost": total + cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in repaired]}


def _first_pass(schema: pa.Schema, part_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tid = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        conv, part, edge, size = None, 0, True, 0  # edge: the conversation may go on in another task or part
        waiting = 0

        def give(rows: list[tuple], whole: bool) -> None:
            if whole:
                out.append({"conv": conv, "part": 0, **_whole(rows)})
            else:
                out.extend({"conv": conv, "part": (tid << 32) + part, "i": i, **dict(zip((f"t_{n}" for n in TURN), r))} for i, r in enumerate(rows))

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return b

        started = False
        for b in batches:
            columns = [b.column(n).to_pylist() for n in TURN]
            rows = list(zip(*columns))
            at = 0
            for key, run_ in groupby(b.column("conv").to_pylist()):
                n = len(list(run_))
                if started and key != conv:
                    give(held, not edge)
                    waiting += size
                    held, part, edge, size = [], 0, False, 0
                    if waiting >= PART_BYTES:
                        waiting = 0
                        yield flush()
                conv, started = key, True
                for r in rows[at : at + n]:
                    held.append(r)
                    size += len(r[2])
                    if len(held) >= part_rows or size >= PART_BYTES:
                        give(held, False)
                        held, part, edge, size = [], part + 1, True, 0
                        yield flush()
                at += n
        if held:
            give(held, False)  # the last one may go on in the next task
        yield flush()

    return run


def _part_table(found: DataFrame, part_rows: int) -> DataFrame:
    """Turns of the conversations that were cut, with ``dup``: whether an equal turn stands earlier."""
    parts = found.where("i IS NOT NULL").select("conv", "part", "i", *[F.col(f"t_{n}").alias(n) for n in TURN])
    place = F.col("part").cast("decimal(19,0)") * part_rows + F.col("i")  # parts carry their task's number in the high bits
    narrow = parts.select("conv", "digest", "part", "i", place.cast("decimal(38,0)").alias("at"))
    first = narrow.groupBy(F.col("conv").alias("_c"), F.col("digest").alias("_d")).agg(F.min("at").alias("_first"))
    later = narrow.join(first, narrow["conv"].eqNullSafe(first["_c"]) & (narrow["digest"] == first["_d"])).where("at > _first")
    later = later.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), F.col("i").alias("_i"))
    met = parts["conv"].eqNullSafe(later["_c"]) & (parts["part"] == later["_p"]) & (parts["i"] == later["_i"])
    return parts.join(later, met, "left").select(parts["*"], F.col("_p").isNotNull().alias("dup"))


def _faults(pdf: pd.DataFrame) -> list[str | None]:
    return ["blank" if b else "duplicate" if d else "truncated" if c else None for b, d, c in zip(pdf["blank"], pdf["dup"], pdf["cut"])]


def _kinds(pdf: pd.DataFrame) -> list[tuple[str, bool, bool]]:
    return [(x, f in ("blank", "duplicate"), f == "truncated") for x, f in zip(pdf["initial"], _faults(pdf))]


def _transfers(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one part makes of every entry stack, and its own counts."""
    pdf = pdf.sort_values("i")
    kinds, faults, initials = _kinds(pdf), _faults(pdf), list(pdf["initial"])
    moves = []
    for stack in reachable():
        front, total, _ = parse(kinds, stack)
        moves.append([stack, [[s, total + c, r] for s, c, r in front]])
    row = {
        "conv": pdf["conv"].iloc[0], "part": pdf["part"].iloc[0], "moves": json.dumps(moves), "first": initials[0], "last": initials[-1],
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": _illegal(initials),
    }
    return pd.DataFrame([row])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry stack, exit rank and end inserts of each part of one conversation; its cost and illegal pairs stand on every row."""
    pdf = pdf.sort_values("part")
    front: Front = ((START, 0, 0),)
    ways = []  # per part: for each rank after it, (rank before it, entry stack, rank among the exits of that entry)
    for moves in pdf["moves"]:
        table = {tuple(stack): ends for stack, ends in json.loads(moves)}
        best: dict = {}
        for stack, cost, rank in front:
            for end, more, r in table[stack]:
                end, new = tuple(end), (cost + more, (rank, r), stack)
                if end[-1] not in best or new < best[end[-1]][0]:
                    best[end[-1]] = (new, end)
        tops = sorted(best.values(), key=lambda x: x[0][1])
        front = tuple((end, cost, k) for k, ((cost, _, _), end) in enumerate(tops))
        ways.append([(audit[0], stack, audit[1]) for (_, audit, stack), _ in tops])
    cost, rank, added = accept(front)
    rows = []
    for part, way in zip(reversed(list(pdf["part"])), reversed(ways)):
        rank, stack, r = way[rank]
        rows.append({"part": part, "entry": json.dumps(stack), "leave": r, "added": "" if rows else added})
    out = pd.DataFrame(rows)
    out["conv"] = pdf["conv"].iloc[0]
    out["cost"] = cost
    pairs = zip(list(pdf["last"])[:-1], list(pdf["first"])[1:])
    out["illegal"] = int(pdf["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in pairs)
    for f in ("blank", "duplicate", "truncated"):
        out[f] = int(pdf[f].sum())
    return out


def _repair_part(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    entry = tuple(json.loads(pdf["entry"].iloc[0]))
    _, _, back = parse(_kinds(pdf), entry)
    audit = audit_of(back, int(pdf["leave"].iloc[0])) + pdf["added"].iloc[0]
    turns = apply(audit, list(zip(pdf["role"], pdf["text"], pdf["initial"])), entry)
    row = {"conv": pdf["conv"].iloc[0], "part": pdf["part"].iloc[0], "audit": audit, "turns": [{"role": r, "text": t} for r, t in turns]}
    return pd.DataFrame([row])


def repair(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Per part of a conversation: conv_id, part (ascending), parts, audit and repaired turns of the part; gaps, blank, duplicate,
    truncated, illegal and cost of the whole conversation stand on every part. Nearly all conversations have one part."""
    kind, turn = type_of(rows, "conv_id"), type_of(rows, "turn")
    numbers = ", ".join(f"{n} bigint" for n in NUMBERS)
    schema = (
        f"conv {kind}, part bigint, i int, t_turn {turn}, t_role binary, t_text binary, t_digest binary, t_initial string, t_blank boolean, t_cut boolean, "
        f"{numbers}, audit string, turns {TURNS}"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    found = stored(_ordered(rows).mapInArrow(_first_pass(to_arrow_schema(StructType.fromDDL(schema)), part_rows), schema))
    whole = found.where("i IS NULL").select("conv", "part", F.lit(1).cast("bigint").alias("parts"), *NUMBERS, "audit", "turns")

    parts = stored(_part_table(found, part_rows))
    by_part = parts.select("conv", "part", "i", "initial", "blank", "cut", "dup").groupBy("conv", "part")
    moves = by_part.applyInPandas(
        _transfers, f"conv {kind}, part bigint, moves string, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    )
    ways = moves.groupBy("conv").applyInPandas(
        _chain,
        f"part bigint, entry string, leave int, added string, conv {kind}, cost bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint",
    )
    ways = stored(ways)
    entered = ways.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), "entry", "leave", "added")
    met = lambda a, b: a["conv"].eqNullSafe(b["_c"]) & (a["part"] == b["_p"])
    pieces = parts.join(entered, met(parts, entered)).drop("_c", "_p").groupBy("conv", "part").applyInPandas(
        _repair_part, f"conv {kind}, part bigint, audit string, turns {TURNS}"
    )
    turns = parts.groupBy("conv", "turn").agg(F.lit(1).alias("_1")).groupBy(F.col("conv").alias("_c"))
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("bigint").alias("gaps"), F.lit(0).cast("bigint").alias("_p"))
    gaps = gaps.select("_c", F.coalesce("gaps", F.lit(0)).alias("gaps"))
    numbers = ways.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), *[n for n in NUMBERS if n != "gaps"])
    count = ways.groupBy(F.col("conv").alias("_k")).agg(F.count(F.lit(1)).alias("parts"))
    long = pieces.join(numbers, met(pieces, numbers)).drop("_c", "_p")
    long = long.join(gaps, long["conv"].eqNullSafe(gaps["_c"])).drop("_c")
    long = long.join(count, long["conv"].eqNullSafe(count["_k"])).select("conv", "part", "parts", *NUMBERS, "audit", "turns")
    return whole.unionByName(long).withColumnRenamed("conv", "conv_id")


def _lines(turns: Column) -> Column:
    """The repaired turns of a part as text: ``role:text`` lines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(b":"), t["text"]).cast("string")), "\n")


def _digests(kind: pa.DataType):
    """Audit and checksum of conversations with several parts, which come sorted; one part is held at a time."""
    schema = pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        pieces = ((r["conv_id"], r) for b in batches for r in b.to_pylist())
        for conv, group in groupby(pieces, key=lambda x: x[0]):
            sha, audit, line = hashlib.sha256(), [], False
            for _, r in group:
                audit.append(r["audit"])
                if r["n_turns"]:
                    sha.update((b"\n" if line else b"") + r["lines"].encode())
                    line = True
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

    return run


def summary(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per id of ``ids``: the numbers, the whole audit and the SHA-256 of the repaired ``role:text`` lines."""
    from pyspark.sql.pandas.types import to_arrow_type

    one = repaired.where("parts = 1").select("conv_id", *NUMBERS, "audit", F.sha2(_lines(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    many = repaired.where("parts > 1")
    pieces = many.select("conv_id", "part", "audit", _lines(F.col("turns")).alias("lines"), F.size("turns").alias("n_turns"))
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    digests = _digests(to_arrow_type(repaired.schema["conv_id"].dataType))
    texts = pieces.mapInArrow(digests, f"conv_id {type_of(repaired, 'conv_id')}, audit string, repaired_sha256 string")
    texts = texts.select(F.col("conv_id").alias("_k"), "audit", "repaired_sha256")
    numbers = many.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in NUMBERS])
    several = numbers.join(texts, numbers["conv_id"].eqNullSafe(texts["_k"])).select("conv_id", *NUMBERS, "audit", "repaired_sha256")
    found = one.unionByName(several).withColumnRenamed("conv_id", "_k")
    ids = ids.select("conv_id").distinct()
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["_k"]), "left")
    return out.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
