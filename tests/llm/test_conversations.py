"""Conversation repair against exhaustive search and plain dynamic programming, and its defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from quotemill.llm import conversations, queries
from quotemill.llm.conversations import END, FAR, KEPT, MUST_GO, NEXT, before, table_of, walk

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def solved(messages):
    """(cost, audit, repaired lines) by forward search over (cost, audit) of each state: state is what has been written."""
    best = {"": (0, "", ())}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(into, state, new):
        if state not in into or new[:2] < into[state][:2]:
            into[state] = new
            return True
        return False

    def inserted(at):
        queue = list(at)
        while queue:
            s = queue.pop()
            cost, audit, lines = at[s]
            r = "a" if s == "u" else "u"
            name = "assistant" if r == "a" else "user"
            if better(at, r, (cost + 2, audit + "I", (*lines, name + ":"))):
                queue.append(r)

    for role, text, fault in messages:
        inserted(best)
        now = {}
        for s, (cost, audit, lines) in best.items():
            better(now, s, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] and role[:1] in allowed[s]:
                better(now, role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            r = "a" if s == "u" else "u"
            better(now, r, (cost + 2 + more, audit + "R", (*lines, f"{'assistant' if r == 'a' else 'user'}:{text}")))
        best = now
    inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows, before):
    groups = defaultdict(list)
    for c, *x in rows:
        groups[c].append(x)
    out = []
    for c in {r[0] for r in before}:
        own = sorted(groups[c], key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, audit, lines = solved([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=repr)


def talk(n, seed, longest=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \t", "Is it?  ", "é", "\x1c"]
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "usher"])
            rows.append((None if c == 3 else c, None if r.random() < 0.05 else t * r.choice([1, 1, 1, 2]), role, None if r.random() < 0.03 else r.choice(texts) + (str(r.random()) + "." if r.random() < 0.5 else "")))
    return rows


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_repair(spark, block):
    rows = talk(150, 1) + talk(4, 2, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    left = damaged(rows)
    assert sorted(map(repr, conversations.damage(df).collect())) == sorted(map(repr, spark.createDataFrame(left, SCHEMA).collect()))
    assert got(conversations.repair(conversations.damage(df), df, block=block)) == brute(left, rows)


def test_one_conversation(spark):
    """All rows in one conversation, over many blocks."""
    r = random.Random(5)
    rows = [(7, i // 2, r.choice(["user", "assistant", "system"]), f"text {r.randrange(400)}" + r.choice(".?, ")) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(conversations.repair(df, block=100)) == brute(rows, rows)


def test_repair_odd(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (2, 5, "system", "S."), (3, 1, "user", "U." * 60000), (3, 1, "user", "U." * 60000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "fault", "copy", "id", "row", "n", "pos", "block")})
    every = df.select("conv_id").union(spark.sql("select 99L"))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(conversations.repair(df, every)) == brute(plain, plain + [(99,)])
    assert got(conversations.repair(conversations.damage(df), df)) == brute(damaged(rows), rows)
    assert conversations.repair(df.filter("false")).count() == 0
    assert got(conversations.repair(df.filter("false"), every.filter("conv_id = 99"))) == [(99, 0, 0, 0, 0, 0, 0, "", sha(""))]


def plain_costs(codes):
    """Backward costs of all states at all places, without checkpoints."""
    out = [END]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def test_costs_against_search():
    """The costs are those of the shortest way in the graph of (place, state)."""
    r = random.Random(3)
    for _ in range(200):
        codes = [r.randrange(9) for _ in range(r.randrange(8))]

        @cache
        def least(i, s, inserted=0, codes=tuple(codes)):
            ways = [0] if i == len(codes) and s in (0, 3) else [FAR]
            if inserted < 3:
                ways.append(2 + least(i, NEXT[s], inserted + 1))
            if i < len(codes):
                ways.append(3 + least(i + 1, s))
                if codes[i] != MUST_GO:
                    ways.append(2 + codes[i] % 2 + least(i + 1, NEXT[s]))
                    if KEPT[s][codes[i] // 2] >= 0:
                        ways.append(codes[i] % 2 + least(i + 1, KEPT[s][codes[i] // 2]))
            return min(ways)

        costs, audits, ends = walk(codes, END, [0, 1, 2, 3], True)
        assert list(costs) == [least(0, s) for s in range(4)] == list(plain_costs(codes)[0])
        assert all(e in (0, 3) for e in ends)
        table = table_of(codes)
        assert [min(table[4 * s + e] + END[e] for e in range(4)) for s in range(4)] == list(costs)
        for audit in audits:
            assert len(re.findall("[DKR]", audit)) == len(codes)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(damaged(rows), rows)
