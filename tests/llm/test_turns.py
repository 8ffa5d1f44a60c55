"""Conversation repair against an exhaustive search and a plain forward search."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import product

import pytest

from cohortry.llm import turns
from cohortry.llm.scratch import Scratch

SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, uid string, part string"


def forward(initials, kinds):
    """Cheapest and least edits, state by state."""
    states = {"": (0, "")}

    def inserted(states):
        out = {}
        for state, (cost, audit) in states.items():
            for n in range(3):
                out[state] = min(out.get(state, (cost, audit)), (cost, audit))
                state, cost, audit = "a" if state == "u" else "u", cost + 3, audit + "I"
        return out

    for c, kind in zip(initials, kinds):
        found = {}
        for state, (cost, audit) in inserted(states).items():
            want, more = "a" if state == "u" else "u", 3 * (kind == 2)
            ways = [(state, cost + 4, audit + "D")]
            if kind != 1:
                ways.append((want, cost + more + 3 * (c != want), audit + ("K" if c == want else "R")))
                if c == "s" and not state:
                    ways.append(("s", cost + more, audit + "K"))
            for to, *way in ways:
                found[to] = min(found.get(to, tuple(way)), tuple(way))
        states = found
    ends = inserted(states)
    return min(ends[s] for s in ("", "a") if s in ends)


def exhaustive(initials, kinds):
    best = None
    for edits in product("DKR", repeat=len(initials)):
        for gaps in product(range(3), repeat=len(initials) + 1):
            state, cost, audit, fine = "", 0, "", True
            for k, n in enumerate(gaps):
                for _ in range(n):
                    state, cost, audit = "a" if state == "u" else "u", cost + 3, audit + "I"
                if k == len(initials):
                    break
                e, c, want = edits[k], initials[k], "a" if state == "u" else "u"
                if e == "D":
                    cost += 4
                elif kinds[k] == 1 or e == "K" and c != want and not (c == "s" and not state):
                    fine = False
                    break
                else:
                    cost += 3 * (kinds[k] == 2) + 3 * (e == "R")
                    state = c if e == "K" else want
                audit += e
            if fine and state in ("", "a"):
                best = min(best or (cost, audit), (cost, audit))
    return best


def cases(seed, n, longest):
    rng = random.Random(seed)
    for _ in range(n):
        size = rng.randint(0, longest)
        style = rng.random()
        initials = [rng.choice("uaaus x") if style < 0.5 or rng.random() < 0.2 else "ua"[k % 2] for k in range(size)]
        yield initials, [rng.choice([0, 0, 0, 1, 2] if style < 0.7 else [0]) for _ in range(size)]


def test_alignment_against_all_edits():
    for initials, kinds in cases(1, 250, 3):
        assert forward(initials, kinds) == exhaustive(initials, kinds) == turns.whole(initials, kinds), (initials, kinds)


def test_alignment_of_longer_conversations():
    for initials, kinds in cases(2, 1500, 14):
        assert turns.whole(initials, kinds) == forward(initials, kinds), (initials, kinds)
    for initials, kinds in cases(3, 40, 120):
        assert turns.whole(initials, kinds) == forward(initials, kinds)


def test_segments_give_the_same(monkeypatch):
    """Cut anywhere, chained, and closed."""
    import pyarrow as pa

    rng = random.Random(5)
    for initials, kinds in cases(4, 400, 24):
        edges = sorted({0, len(initials), *(rng.randint(0, len(initials)) for _ in range(rng.randint(0, 4)))})
        parts = []
        for k, (a, b) in enumerate(zip(edges, edges[1:] or [0])):
            s = turns.Segment(7, True)
            for i in range(a, b):
                s.add(i, initials[i], f"{i}", kinds[i], False)
            parts.append({"conv_id": 7, "part": 0, "k": k, **s.part()})
        table = pa.Table.from_pylist(parts or [{"conv_id": 7, "part": 0, "k": 0, **turns.Segment(7, True).part()}])
        way = turns.chain(table).to_pylist()
        audit = "".join(p["audits"][w["way"]] for p, w in zip(parts or [turns.Segment(7, True).part()], way)) + way[-1]["closing"]
        assert (way[-1]["cost"], audit) == forward(initials, kinds)


def brute(rows):
    """Damage, faults and repair of all conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            live += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, kinds = set(), Counter(), []
        for _, role, text in live:
            inner = text.strip(SPACE)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "" if inner[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            kinds.append({"": 0, "truncated": 2}.get(fault, 1))
        initials = [r[1][:1] for r in live]
        cost, audit = forward(initials, kinds)
        lines, at, state = [], 0, ""
        for e in audit:
            want = "a" if state == "u" else "u"
            role, text = ({"a": "assistant", "u": "user"}[want], "") if e == "I" else live[at][1:]
            at += e != "I"
            if e != "D":
                lines.append((f"{role}" if e != "R" else {"a": "assistant", "u": "user"}[want]) + ":" + text)
                state = lines[-1][0]
        known = {r[0] for r in live} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows(seed=1, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "and so on", "", " \t", "Sure.\n", "x" * 5000 + ".", "Ünï.", None]
    out = []
    for conv in [None, *range(-3, convs)]:
        for turn in range(rng.randint(1, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "tool", "", None])
            out.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, rng.choice(texts) if rng.random() < 0.4 else f"Line {conv} {turn}."))
    for turn in range(700):  # one conversation with more than half of all rows
        out.append((1000, turn // 2 * 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "Open", f"Turn {turn}!", f"Turn {turn}!"])))
    out += [(1001, None, "user", "Hi.")] * 90 + [(1002, 5, "user", "Hi."), (1002, 5, "user", "Hi."), (1002, 9, "assistant", "Hi.")]
    return out


@pytest.mark.parametrize("segment,parts", [(64, 8), (5, 3), (10_000, 1)])
def test_repair(spark, monkeypatch, segment, parts):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    docs = rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "u", "p") for r in docs], SCHEMA).repartition(5)
        want, got = brute(docs), turns.damaged_and_repaired(df, Scratch(spark, "t")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got} == want and len(got) == len(want)


def test_a_long_conversation(spark):
    """Half of all rows in one conversation of many ranges and segments."""
    rng = random.Random(3)
    docs = [(1, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2], rng.choice(["Same.", "Open", f"{t}.", f"{t}?"])) for t in range(2_000)]
    docs += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(2, 400) for t in range(5)]
    df = spark.createDataFrame(docs, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.damaged_and_repaired(df, Scratch(spark, "t")).collect()}
    assert got == brute(docs)


def test_nothing(spark):
    assert turns.damaged_and_repaired(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    docs = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in turns.query(spark, "/root/testdata/sf0.01").collect()} == brute(docs)
