"""The trie against a plain one, on written conversations with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, span=100, most=6):
    """All nodes, from a dictionary of prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = f"{role}\0{text}"
            turns[c].append((turn is not None, turn or 0, said[:64], hashlib.md5(said.encode()).hexdigest(), role, text))
    turns = {c: [t[4:] for t in sorted(x)] for c, x in turns.items()}
    members = defaultdict(list)
    for c in turns:
        base = c - (c % span if c >= 0 else -(-c % span))
        h = zlib.crc32(str(c).encode()) % most
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, below = [], {}
    for path in sorted(members, key=len, reverse=True):
        kids = children[path]
        ids = sorted(c for c, _ in members[path])
        leaves = sum(below[k][0] for k in kids) or 1
        saved = sum(below[k][1] for k in kids) + ((len(ids) - 1) * len(path[-1][1]) if path else 0)
        below[path] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c, end in members[path] if end))
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        out.append((ids[0], len(path), parent, len(ids), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def written():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(90, 130), 200, 305, 399, -7, -100, -205]:
        start = rng.choice(["one", "two"])
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"{start} {turn} {rng.choice('ab')} é€"))
    rows += [(c, t, "user", f"same {t}") for c in range(600, 640) for t in range(4)]  # copies
    rows += [(c, t, "user", f"long {t}") for c in (700, 800) for t in range(9)]  # share all turns but the last
    rows += [(800, 9, "user", "last"), (700, 9, "user", "end")]
    rows += [(900, t, "user", f"alone {t % 5}") for t in range(300)]  # a chain
    rows += [(901, None, "b", "tie"), (901, None, "a", "tie"), (901, 0, None, None), (901, 0, None, "x"), (901, 0, None, "x"), (901, 0, "", "y" * 70 + "1"), (901, 0, "", "y" * 70 + "0")]
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None), (1000, 0, "user", "w" * 100_000), (1100, 5, "user", "w" * 100_000)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    odd = spark.createDataFrame(written(), SCHEMA).withColumns({"node": F.lit("clash"), "depth": F.lit("clash"), "c": F.lit(None)})
    return odd.repartition(3)


def collected(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("chunk, block", [(conversation_trie.CHUNK, conversation_trie.BLOCK), (3, 4)])
def test_as_a_plain_trie(spark, table, monkeypatch, chunk, block):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    got = collected(conversation_trie.trie(table))
    want = plain(written())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert got == want
    assert any(r[3] == 40 and r[1] == 4 for r in got)


def test_sql_says_the_same(table):
    frame = table.select("conv_id", "turn", "role", "text").toPandas()
    con = duckdb.connect()
    con.register("frame", frame)
    con.sql("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM frame")
    rows = con.sql(conversation_trie.ORACLE).project(", ".join(COLUMNS)).fetchall()
    assert sorted(rows) == plain(written())


def test_without_rebuilding(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (3, 0, "u", "a"), (3, 1, "u", "b")]
    got = collected(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA), span=1))
    assert [r[:7] for r in got] == [(1, 0, None, 3, 1, 2, 3), (1, 1, 1, 3, 2, 2, 3), (1, 2, 1, 2, 0, 1, 1), (2, 2, 1, 1, 0, 1, 0)]


def test_copies_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    rows = [(c, t, "u", "abc"[: t % 4]) for c in (5, 6, 8) for t in range(50)]
    got = collected(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA), span=1))
    assert got == plain(rows, 1)


def test_of_nothing_and_of_one(spark):
    assert collected(conversation_trie.trie(spark.createDataFrame([], SCHEMA))) == []
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0
    absent = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)  # begins with turns of a conversation that isn't there
    one = [(absent, 0, "u", "x")]
    assert collected(conversation_trie.trie(spark.createDataFrame(one, SCHEMA))) == plain(one)
    assert len(plain(one)) == 1
