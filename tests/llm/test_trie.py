"""Operator 12: equal to a plain trie on random conversations; the query equals SQL; ends of any number are hashed in order."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from touchline.llm import trie as T


def plain(rows, rebuilt=True):
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    if rebuilt:
        old = turns
        turns = {}
        for c, own in old.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = c - int(c / 20) * 20
            turns[c] = old.get(c - base, [])[:h] + own[h:]
    members = {}
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    nodes = list(members)
    children = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in members[n] if len(turns[c]) == len(n))))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(members[n]), len(n), parent, len(members[n]), len(children[n]), sum(not children[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed):
    draw = random.Random(seed)
    out = []
    for c in [*range(0, 64), 100, 119, 120, 121, -1, -25, 10**12 + 7]:
        out += [(c, draw.choice([None, k, k, k]), draw.choice(["user", "assistant", None]), draw.choice(["a", "b c", "b\tc ", "", None])) for k in range(draw.choice([1, 2, 3, 6]))]
    out += [(None, 0, "user", "x"), (20, 0, "user", "same"), (20, 0, "user", "same"), (33, 2, None, "z " * 3000)]
    draw.shuffle(out)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_plain(spark, seed):
    found = rows(seed)
    frame = spark.createDataFrame([(*r, "x", "y") for r in found], SCHEMA + ", key string, depth string")
    got = T.shared_openings(frame)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(found)


def test_trie_as_it_is(spark):
    found = rows(7)
    frame = spark.createDataFrame(found, SCHEMA)
    nodes = T.conversation_trie(frame)
    assert sorted(map(tuple, nodes.drop("key").collect()), key=str) == plain(found, rebuilt=False)
    said = T.last_turns(nodes, frame).collect()
    assert len(said) == nodes.count() and all((r.role is None) == (r.depth == 0) for r in said)


def test_empty_table(spark):
    assert T.shared_openings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.shared_openings(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_ends_in_runs(spark):
    ids = [(("k" if i % 3 else "m"), i) for i in range(-30000, 30000)]
    frame = spark.createDataFrame(ids, "key string, conv_id long").repartition(5)
    got = dict(map(tuple, T.ends_of(frame).collect()))
    assert got == {k: hashlib.sha256(",".join(str(i) for x, i in ids if x == k).encode()).hexdigest() for k in "km"}


def test_query_equals_sql(spark, sf_dir):
    def both(df, con):
        got = T.shared_openings(df)
        cursor = con.execute(T.SQL)
        assert sorted(got.columns) == sorted(c[0] for c in cursor.description)
        at = [[c[0] for c in cursor.description].index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    both(spark.read.parquet(f"{sf_dir}/conversations.parquet"), con)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows(5))
    both(spark.createDataFrame(rows(5), SCHEMA), con)
