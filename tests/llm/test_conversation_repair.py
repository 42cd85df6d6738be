"""Repairs against a search over all edits, with small chunks, without fix-up passes, and on odd tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from savora.llm import conversation_repair as repair

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id long, turn long, role string, text string, id string, n long, g long"


def cheapest(rows):
    """(cost, audit, repaired) of (initial, gone, truncated, role, text): Dijkstra over (row, state), least audit first."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        for x, t in NEXT[state].items():
            if x != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", k, t, (*lines, {"u": "user:", "a": "assistant:"}[x])))
        if k < len(rows):
            initial, gone, late, role, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, lines))
            for x, t in NEXT[state].items() if not gone else ():
                if x == initial:
                    heapq.heappush(heap, (cost + late, audit + "K", k + 1, t, (*lines, f"{role}:{text}")))
                if x != "s":
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", k + 1, t, (*lines, f"{ {'u': 'user', 'a': 'assistant'}[x]}:{text}")))


def expected(rows):
    """rows: (turn, role, text), damaged."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated"), role, text))
    turns = {r[0] for r in rows} - {None}
    illegal = sum((a[0], b[0]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(judged))
    cost, audit, text = cheapest(judged)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub(r"[.!?]", "", text) if way == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1))
    return {conv: expected(v) for conv, v in by.items()}


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["Fine.", "What?", "cut off", "", " \n", "Fine. ", "x" * 300_000, None, "é🎉!", "a:b\nc."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "u"]
    out = [(conv, turn, rng.choice(roles), rng.choice(texts), "x", 1, 2) for conv in range(60) for turn in rng.sample(range(12), rng.randrange(1, 9))]
    out += [(900, k, rng.choice(roles[:5]), f"t{k}{rng.choice('.!, ')}", "x", 1, 2) for k in range(300)]  # long
    out += [(901, k, "user", f"t{k}.", "x", 1, 2) for k in range(200)]  # vectors that never converge
    out += [(902, k, "user", "same.", "x", 1, 2) for k in range(150)] + [(903, 5, "user", "same.", "x", 1, 2)] * 150
    out += [(None, 1, "user", "Hm.", "x", 1, 2), (None, None, "assistant", "Hm.", "x", 1, 2), (904, None, "user", "b.", "x", 1, 2), (904, None, "user", "a.", "x", 1, 2), (904, 3, "user", "a.", "x", 1, 2)]
    lost = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*out, (lost, 0, "user", "Gone.", "x", 1, 2)]


@pytest.mark.parametrize(("chunk", "passes"), [(64, 4), (3, 0), (2, 1), (5, 50)])
def test_against_search(spark, rows, chunk, passes):
    turns = repair.damage(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = repair.report(turns, copies=F.col("copies"), chunk=chunk, passes=passes)
    assert got.columns == ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert reported(got) == damaged(rows)


def test_repaired_turns_follow_the_pattern(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    got = repair.repaired_turns(turns, id_col="conv_id", chunk=4).orderBy("id", "piece", "place").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values()) and len(by) > 50


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damage(none), copies=F.col("copies")).count() == 0
    few = spark.createDataFrame([("k", 0, "user", "A."), (None, 0, "user", "B.")], "conv_id string, turn int, role string, text string")
    got = reported(repair.report(few, id_col="conv_id"))
    assert {k: v[6] for k, v in got.items()} == {"k": "DI"[:0] + "KI", None: "KI"}


def test_query_and_sql(spark, rows, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).select("conv_id", "turn", "role", "text").write.parquet(f"{at}/conversations.parquet")
    got = reported(repair.op11_conversation_repair(spark, at))
    assert got == damaged(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(repair.OP11_SQL).fetchall() if r[0] not in (901, 902, 903)} == {k: v for k, v in got.items() if k not in (901, 902, 903)}
