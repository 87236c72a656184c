"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from itertools import groupby

import duckdb
import pytest

from creditloom.llm import conversation_repair as cr
from creditloom.llm import queries

FULL = "conv_id bigint, turn bigint, role string, text string"
COST = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "cut": 5}


def damaged(rows):
    """(turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        written = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(written.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if fault == 4 else role
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(fault, text)
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return sorted(
        out,
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()),
    )


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        content = text.strip(" \t\n\x0b\x0c\r")
        if not content:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if content[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found, cost=COST):
    """Least (cost, audit), by a search that goes through all of them in that order."""
    heap, done = [(0, "", 0, "")], set()
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    while heap:
        paid, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a", "end"):
            return paid, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        for x in "ua":
            if (state, x) in grammar:
                heapq.heappush(heap, (paid + cost["insert"], audit + "I", at, grammar[state, x]))
        if at < len(rows):
            heapq.heappush(heap, (paid + cost["delete"], audit + "D", at + 1, state))
            if found[at] in ("blank", "duplicate"):
                continue
            extra = cost["cut"] if found[at] == "truncated" else 0
            for x, edit in [(rows[at][1][:1], "K"), ("u", "R"), ("a", "R")]:
                if (state, x) in grammar:
                    price = cost["keep" if edit == "K" else "rerole"] + extra
                    heapq.heappush(heap, (paid + price, audit + edit, at + 1, grammar[state, x]))


def expected(rows):
    rows = damaged(rows)
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(rows, found)
    lines, state, rest = [], "", iter(rows)
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        lines.append(f"{role}:{text}")
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(found.count(k) for k in ("blank", "duplicate", "truncated")),
        illegal,
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def by_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return {c: expected([*g]) for c, g in groupby(rows, key=lambda r: r[0])}


def found_by(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark, sf):
    rows = duckdb.connect().execute(f"from '{sf}/conversations.parquet'").fetchall()
    df = queries.queries()["op12_conversation_repair"](spark, sf)
    assert df.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]
    assert found_by(df) == by_conversation(rows)


def random_rows(rng, n_convs, longest):
    texts = ["Yes.", "No?", "cut off", " \n", "", None, "Why!", "odd . ", "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "sage"]
    rows = []
    for conv in [None, *range(n_convs)]:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(longest)])
            rows.append((conv, turn, rng.choice(roles), f"{rng.choice(texts) or ''}" or None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Nulls, ties, repeated rows, other roles; columns of clashing names."""
    rng = random.Random(seed)
    rows = random_rows(rng, 150, 9)
    df = spark.createDataFrame(
        [(*r, "c", "c", "c") for r in rows], f"{FULL}, copies string, kind string, audit string"
    )
    assert found_by(cr.repair(df)) == by_conversation(rows)
    assert cr.repair(df.limit(0)).count() == 0


def test_one_conversation_over_many_blocks(spark, conf):
    """A conversation that is nearly the whole table, and a very long text."""
    conf(shuffle__partitions="13")
    rng = random.Random(4)
    rows = [
        (1, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.choice('abc')} {t % 40}" + rng.choice(". "))
        for t in range(1200)
    ]
    rows += [(2, 1, "user", "word " * 200_000 + "."), (2, 2, "assistant", "So."), (None, None, None, None)]
    assert found_by(cr.repair(spark.createDataFrame(rows, FULL))) == by_conversation(rows)


def test_repaired_rows(spark):
    rows = [(5, t, "user", f"t{t}.") for t in range(6)]
    damaged_df = cr.damaged_rows(spark.createDataFrame(rows, FULL))
    found = cr.find_repairs(damaged_df)
    out = cr.repaired_rows(damaged_df, found).orderBy("place").collect()
    audit = found.first().audit
    assert "".join(r.edit for r in out) == audit
    kept = [(r.role, r.text) for r in out if r.edit != "D"]
    assert [r[0][0] for r in kept] == ["u", "a"] * (len(kept) // 2)


def run_rows(rows, found, costs=cr.Costs(), cuts=()):
    """Cost and audit by the survivors, in blocks that are cut at ``cuts``."""
    rules = cr.Rules(costs)
    kinds = {"": cr.WHOLE, "truncated": cr.CUT}
    whole, at = cr.Survivors(rules), 0
    open_edits = 0
    for end in [*cuts, len(rows)]:
        moves = {}
        for start in cr.STATES:
            run = cr.Survivors(rules, start)
            for (_, role, _), fault in zip(rows[at:end], found[at:end]):
                run.step(rules.steps(role[:1], kinds.get(fault, cr.GONE)))
                open_edits = max(open_edits, sum(len(b) for b in open_segments(run)))
            for behind, cost, audit in run.table():
                moves.setdefault(behind, []).append((start, cost, audit))
        whole.step([*moves.items()])
        at = end
    whole.step(rules.endings)
    ((_, cost, audit),) = whole.table()
    return (cost, audit.decode()), open_edits


def open_segments(run):
    segments = {}
    for _, leaf in run.alive.values():
        for s in run._path(leaf):
            segments[id(s)] = s.edits
    return segments.values()


@pytest.mark.parametrize(
    "costs", [COST, COST | {"insert": 1}, COST | {"cut": 0, "delete": 3}, COST | {"insert": 2, "rerole": 2}]
)
def test_survivors_against_all_audits(costs):
    rng = random.Random(str(costs))
    for _ in range(400):
        rows = [
            (0, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice("abcde"))
            for _ in range(rng.randint(0, 12))
        ]
        found = [rng.choice(["", "", "truncated", "blank"]) for _ in rows]
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 3))))
        got, _ = run_rows(rows, found, cr.Costs(**costs), cuts)
        assert got == cheapest(rows, found, costs), (rows, found)


def test_survivors_coalesce():
    """What is open stays short on ordinary conversations, however long they are."""
    rng = random.Random(6)
    rows = [(t, "system" if t == 0 else "user assistant".split()[t % 2 ^ 1], "x.") for t in range(5000)]
    rows = [(t, rng.choice(["user", role, role, role]), x) for t, role, x in rows]
    found = [rng.choice(["", "", "", "", "blank", "truncated"]) for _ in rows]
    (cost, audit), open_edits = run_rows(rows, found)
    assert open_edits < 200 and len(audit) >= 5000 and cost > 0


def test_survivors_that_never_meet():
    """All rows of one role: two survivors disagree on the first row to the end."""
    rows = [(t, "user", f"{t}.") for t in range(4001)]
    (cost, audit), open_edits = run_rows(rows, [""] * len(rows))
    assert (cost, audit) == (2002, "D" + "KR" * 2000)
    assert 4000 < open_edits < 20_000


def test_costs_that_break_the_search():
    with pytest.raises(ValueError):
        cr.Costs(rerole=3)
