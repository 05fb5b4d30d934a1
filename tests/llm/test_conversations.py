"""Prefix trie and structure repair of conversations against brute force, and their defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import pytest

from queryscope.llm import queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, node long, part long, size int"
EXTRA = ("k", 1, 2, 3)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def registered(name, spark, rows, tmp_path):
    folder = tmp_path / str(random.random())
    table(spark, rows).write.parquet(f"{folder}/conversations.parquet")
    return queries.QUERIES[name](spark, str(folder))


def crc(text):
    return zlib.crc32(text.encode())


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


# --- trie ---------------------------------------------------------------------------------------------------------------


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc(str(c)) % 6
        base = int(c / 100) * 100  # the remainder has the sign of the id, as in SQL
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    least = {p: min(m) for p, m in members.items()}
    kids, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        weight = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not kids[p]
            below[p[:d]][1] += weight
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        parent = least[p[:-1]] if p else None
        out.append((least[p], len(p), parent, len(m), kids[p], *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_rows(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=repr)


def some_conversations(rng, n, longest=7, words="ab"):
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 40), rng.randrange(100, 130), rng.randrange(250, 280), -rng.randrange(1, 120)])
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "assistant", None]), rng.choice([*words, "", None])))
    return rows


def test_trie_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = some_conversations(rng, 250) + [(None, 1, "user", "a"), (500, None, None, None), (500, None, None, None), (7, 3, "user", "é👍" * 3000)]
    got = registered("op11_prefix_trie", spark, rows, tmp_path)
    assert set(got.columns) == set(NODE) and node_rows(got) == brute_trie(rebuilt(rows))


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_trie_of_long_and_equal_conversations(spark, segment):
    """Segments, blocks, merges and pieces of ids far below their usual sizes; a common start, many copies, one very long conversation."""
    rng = random.Random(segment)
    convs = {c: [("user", "hello")] + [("user", rng.choice("ab")) for _ in range(rng.randint(0, 7))] for c in range(200)}
    convs |= {c: [("user", "hello"), ("user", "a"), ("user", "b")] for c in range(1000, 1100)}
    convs |= {2000: [("user", "ab"[i % 2]) for i in range(40)], 2001: [("user", "ab"[i % 2]) for i in range(39)], 2002: [("user", "ab"[i % 2]) for i in range(33)], 3000: []}
    turns = [(c, i, bytes.fromhex(digest(*t)), len(t[1]), len(ts)) for c, ts in convs.items() for i, t in enumerate(ts)]
    turns = spark.createDataFrame(turns, "conv_id long, q long, digest binary, length long, size long")
    sizes = spark.createDataFrame([(c, len(ts)) for c, ts in convs.items()], "conv_id long, size long")
    parts = trie.segments(turns, sizes, segment)
    got = trie.with_end_digests(trie.nodes(parts, segment, block_rows=7, fan=2), parts, piece=5)
    assert node_rows(got) == brute_trie(convs)


def test_trie_of_nothing(spark, tmp_path):
    assert registered("op11_prefix_trie", spark, [], tmp_path).count() == 0
    one = registered("op11_prefix_trie", spark, [(150, 0, "user", "a")], tmp_path).collect()  # its first turns are those of a conversation that is not there
    assert [(r["conv_id"], r["depth"], r["n_convs"]) for r in one] == [(150, 0, 1)]


# --- repair -------------------------------------------------------------------------------------------------------------


def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        if d:
            text = "" if d == 1 else "".join(x for x in text if x not in ".!?") if d == 2 else text
            role = "user" if d == 4 else role
            out[c] += [(turn, role, text)] * (2 if d == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2]))) for c, v in out.items()}


def judged(turns):
    seen, out = set(), []
    for _, role, text in turns:
        end = text.rstrip(repair.SPACE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(turns):
    """(cost, audit, output) over all edits: plain sets of strings at every place, no merging by rank."""
    best = {"": (0, "", ())}

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry
            return True

    def inserts(table):
        todo = list(table)
        while todo:
            state = todo.pop()
            cost, audit, out = table[state]
            for x, name in (("u", "user"), ("a", "assistant")):
                if (to := NEXT.get((state, x))) and better(table, to, (cost + 3, audit + "I", (*out, (name, "")))):
                    todo.append(to)
        return table

    for role, text, fault in turns:
        after = {}
        for state, (cost, audit, out) in inserts(best).items():
            better(after, state, (cost + 4, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if to := NEXT.get((state, role[:1])):
                    better(after, to, (cost + more, audit + "K", (*out, (role, text))))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if to := NEXT.get((state, x)):
                        better(after, to, (cost + 3 + more, audit + "R", (*out, (name, text))))
        best = after
    return min(v for s, v in inserts(best).items() if s in ("", "a"))


def exhaustive(turns, most=2):
    """The same by trying every string of edits with at most ``most`` inserts in a row."""
    found = []
    gaps = ["I" * k for k in range(most + 1)]
    for ops in product("DKR", repeat=len(turns)):
        for ins in product(gaps, repeat=len(turns) + 1):
            audit = ins[0] + "".join(o + i for o, i in zip(ops, ins[1:]))
            state, cost, k = "", 0, 0
            for o in audit:
                role, _, fault = turns[k] if o != "I" else (None, None, None)
                k += o != "I"
                if o == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    state = None
                    break
                x = role[:1] if o == "K" else next((x for x in "ua" if (state, x) in NEXT), None)
                cost += {"I": 3, "K": 0, "R": 3}[o] + (3 if fault else 0)
                state = NEXT.get((state, x))
                if state is None:
                    break
            if state in ("", "a"):
                found.append((cost, audit))
    return min(found)


def brute_repair(rows):
    turns = damaged(rows)
    out = []
    for c in {r[0] for r in rows}:
        own = judged(turns.get(c, []))
        cost, audit, lines = cheapest(own)
        known = {t for t, _, _ in turns.get(c, []) if t is not None}
        initials = [r[:1] for r, _, _ in own]
        faults = [f for _, _, f in own]
        out.append((
            c, max(known) - min(known) + 1 - len(known) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired_rows(df):
    return sorted((tuple(r) for r in df.select(*REPAIRED).collect()), key=repr)


def noisy(rng, convs, longest):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No?", "Go on", "so!\n\t", " ", "", None, "a.b", "ééé。", "d1.", "d2.", "d3!", "d4"]
    return [(c, rng.choice([t, t, t, t + 5, None]), rng.choice(roles), rng.choice(texts)) for c in convs for t in range(rng.randint(1, longest))]


def test_search_is_exhaustive():
    rng = random.Random(2)
    for _ in range(60):
        turns = judged([(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "B", "", "C!", "D?"])) for i in range(rng.randint(0, 3))])
        cost, audit, _ = cheapest(turns)
        assert (cost, audit) == exhaustive(turns)
        front, total, back = repair.parse([(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, _, f in turns])
        least, rank, added = repair.accept(front)
        assert (total + least, repair.audit_of(back, rank) + added) == (cost, audit)


def test_repair_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = noisy(rng, [*range(150), None, -3], 9) + [(900, 0, "user", "x" * 100_000 + "."), (901, 1, "user", "Same."), (901, 1, "user", "Same."), (901, None, "user", "Same.")]
    got = registered("op13_conversation_repair", spark, rows, tmp_path)
    assert set(got.columns) == set(REPAIRED) and repaired_rows(got) == brute_repair(rows)


@pytest.mark.parametrize("part_rows", [1, 4, 50_000])
def test_repair_of_a_conversation_with_most_rows(spark, part_rows):
    """One conversation lies in many tasks and parts; its faults, audit and texts are those of the whole."""
    rng = random.Random(part_rows)
    rows = noisy(rng, range(12), 6) + noisy(rng, [40], 400) + noisy(rng, [41] * 30, 5)
    frame = table(spark, rows)
    assert repaired_rows(repair.summary(repair.repair(repair.damage(frame), part_rows), frame)) == brute_repair(rows)


def test_repair_keeps_texts_and_roles(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Again?"), (2, 0, "assistant", "Hello."), (2, 1, "assistant", "Hello.")]
    got = {r["conv_id"]: r for r in repair.repair(table(spark, rows)).collect()}
    lines = lambda c: [(bytes(t["role"]).decode(), bytes(t["text"]).decode()) for t in got[c]["turns"]]
    assert got[1]["audit"] == "KKR" and lines(1) == [("system", "Be kind."), ("user", "Hi!"), ("assistant", "Again?")]
    assert got[2]["audit"] == "IKD" and lines(2) == [("user", ""), ("assistant", "Hello.")]


def test_repair_of_nothing(spark, tmp_path):
    assert registered("op13_conversation_repair", spark, [], tmp_path).count() == 0
    gone = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    got = registered("op13_conversation_repair", spark, [(gone, 0, "user", "Hi.")], tmp_path).collect()
    assert [tuple(r[n] for n in REPAIRED) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
