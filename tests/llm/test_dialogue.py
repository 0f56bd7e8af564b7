"""Conversation repair against brute force: shortest paths over whole texts of edits, in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from airlens.llm import dialogue
from airlens.llm.queries import SQL

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            out += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows):
    """(cost, audit, repaired turns): Dijkstra over (rows taken, roles so far as a state), the least text of edits first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, turns
        want = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[want]
        heapq.heappush(heap, (cost + 3, audit + "I", at, want, (*turns, (name, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, turns))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, want, (*turns, (name, text))))
                if role[:1] == want or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*turns, (role, text))))
    raise AssertionError


def brute(rows):
    """One conversation's digest."""
    left, seen, found = after_damage(rows), set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in left:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        found.append((role, text, fault))
    turns = [t for t, _, _ in left if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    cost, audit, kept = cheapest(found)
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def whole(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return sorted(((c, *brute(own)) for c, own in by.items()), key=str)


def run(df):
    return sorted((tuple(r) for r in dialogue.repair(dialogue.damaged(df)).select("conv_id", *COLUMNS).collect()), key=str)


def made(seed, talks=150):
    r = random.Random(seed)
    words = ["yes.", "no!", "why?", "cut off", "", "  ", "a.b", "ok.\n", "end. ", "x" * 50 + "."]
    return [(c, r.choice([t, t, t + 1, None, 2 * t]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(words)) for c in [*range(talks), None] for t in range(r.randrange(1, 12))]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = made(seed)
    random.Random(seed).shuffle(rows)
    assert run(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)) == whole(rows)


def test_all_rows_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(conv, 0, "user", "Hello.", "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string")
    assert run(df) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(df.limit(0)) == []


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert run(df) == whole([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_sql_gives_the_same_rows(spark):
    """The registered SQL on damaged, odd conversations, against brute force."""
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = made(7, 60)
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.execute(SQL["op12_conversation_repair"])
    assert [c[0] for c in got.description] == ["conv_id", *COLUMNS]
    assert sorted(got.fetchall(), key=str) == whole(rows)


def test_repaired_turns_are_legal_and_give_the_digest(spark):
    df = dialogue.damaged(spark.createDataFrame(made(5), "conv_id long, turn long, role string, text string"))
    by = {}
    for r in sorted(dialogue.repaired_turns(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for r in dialogue.repair(df).collect():
        turns = by.get(r.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in turns))
        assert "".join(t.edit for t in turns) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == r.repaired_sha256


def test_search_alone_on_all_short_conversations():
    """Every sequence of up to five rows of a small alphabet: cost and edits as brute force."""
    from itertools import product

    kinds = [("user", None), ("assistant", None), ("system", None), ("tool", None), ("user", "blank"), ("assistant", "truncated")]
    for n in range(5):
        for combo in product(kinds, repeat=n):
            search, out = dialogue.Survivors(), []
            for role, fault in combo:
                out += search.put(role[:1], fault == "blank", fault == "truncated")
            cost, rest = search.end()
            assert (cost, "".join(out + rest)) == cheapest([(role, str(i), fault) for i, (role, fault) in enumerate(combo)])[:2]


def test_long_conversation_holds_few_nodes():
    r, search, most, out = random.Random(4), dialogue.Survivors(), 0, []
    for _ in range(20_000):
        out += search.put(r.choice("uuaas"), r.random() < 0.1, r.random() < 0.2)
        most = max(most, search.open_nodes())
    assert most < 200 and len(out) > 19_000


def test_open_ties_are_compared_whole():
    """Rows of no kept role stay undecided between two ways until the end; the texts compare as whole."""
    for n in (3, 8, 41):
        rows = [("tool", str(i), None) for i in range(n)]
        search, out = dialogue.Survivors(), []
        for role, _, _ in rows:
            out += search.put(role[:1], False, False)
        cost, rest = search.end()
        assert (cost, "".join(out + rest)) == cheapest(rows)[:2]
