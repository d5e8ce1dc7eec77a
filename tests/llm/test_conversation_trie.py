"""The conversation trie against a plain walk over all beginnings, with fingerprints that collide, and with one conversation that holds most rows."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from larderflow.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, fp string, `split` int, ends int"


def made(spark, some):
    return spark.createDataFrame([(*r, 1, "f", 2, 3) for r in some], SCHEMA)


def walked(some):
    own = {}
    for c, turn, role, text in some:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - c % 100 if c >= 0 else c + -c % 100
        whole[c] = tuple(own.get(block, [])[:h] + x[h:])
    members = {}
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        out.append((
            len(path), min(inside), min(members[path[:-1]]) if path else None, len(inside), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q != p and q[: len(p)] == p for q in below) for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(c for c in inside if len(whole[c]) == len(path)))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def talks(seed, n):
    """Few roles and texts, so that beginnings are shared; nulls, empty texts, gaps and an odd id or two. No two turns of a conversation are equal in place."""
    r = random.Random(seed)
    out = []
    for c in [*r.sample(range(0, 350), n), 0, 100, -3, -100, 2**40]:
        for turn in range(r.choice([1, 2, 3, 6, 9])):
            out.append((c, None if turn == 0 and r.random() < 0.3 else turn, r.choice(["user", None, ""]), r.choice(["hello", "é😀", "", None])))
    out.append((None, 1, "user", "nobody's"))
    return out


def test_trie_against_a_walk(spark):
    some = talks(1, 40)
    some = list({(c, t): (c, t, role, text) for c, t, role, text in some}.values())
    assert told(trie.trie(made(spark, some))) == walked(some)


def test_colliding_fingerprints_are_split(spark, monkeypatch):
    some = list({(c, t): (c, t, role, text) for c, t, role, text in talks(2, 30)}.values())
    called = []
    plain = trie.split
    monkeypatch.setattr(trie, "split", lambda *a: called.append(1) or plain(*a))
    assert told(trie.trie(made(spark, some), primes=((3, 2), (5, 2)))) == walked(some)
    assert called


def test_equal_turns_and_repeated_rows(spark):
    some = [(7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (8, 1, "user", "a"), (8, 1, "user", "a"), (8, 1, "user", "b"), (205, 0, None, None)]
    assert {r["n_convs"] for r in trie.trie(made(spark, some)).collect() if r["depth"] > 0} <= {1, 2}
    assert told(trie.trie(made(spark, some))) == told(trie.trie(made(spark, some[::-1])))  # whatever the order of the rows


def test_one_conversation_and_one_beginning_hold_most_rows(spark):
    some = [(301, t, "user", f"turn {t}") for t in range(120)] + [(302, t, "user", f"turn {t}") for t in range(120)]
    some += [(c, t, "user", f"turn {t}") for c in range(400, 440) for t in range(2)]
    df = made(spark, some)
    assert told(trie.trie(df)) == walked(some)
    # its rows are scanned by several tasks
    spread = trie.turns(df).repartitionByRange(4, "conv_id", F.col("turn").asc_nulls_first(), *trie.KEYS).filter("conv_id = 301").select(F.spark_partition_id()).distinct().count()
    assert spread > 1


def test_scans_over_several_tasks(spark):
    rows = [(k, i, (k * 7 + i) % 5) for k, n in ((1, 300), (2, 1), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, i long, v long").withColumns({"total": F.col("v"), "p": F.lit(9), "f": F.col("v")})
    out = trie.scanned(df, "key", ["i"], [trie.Scan("total"), trie.Scan("p", 10, 97, "p"), trie.Scan("f", 10, 97, "p")], "scan")
    got = {(r["key"], r["i"]): (r["total"], r["p"], r["f"]) for r in out.collect()}
    for k in (1, 2, 3):
        total = f = 0
        for n, (_, i, v) in enumerate(r for r in rows if r[0] == k):
            total, f = total + v, (f * 10 + v) % 97
            assert got[k, i] == (total, (pow(10, n + 1, 97) - 1) % 97, f)


def test_turnless_and_empty(spark):
    # 3: crc32 leaves nothing of a conversation that is no longer than h, where its block has no beginning
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert told(trie.trie(made(spark, [(c, 1, "user", "gone")]))) == [(0, c, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.trie(made(spark, [])).count() == 0
    assert trie.trie(made(spark, [(None, 1, "a", "b")])).count() == 0


def test_ends_of_a_node_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    some = [(c, 1, "user", "same") for c in range(500, 600)]
    assert told(trie.trie(made(spark, some))) == walked(some)


def test_its_sql_says_the_same(spark):
    some = list({(c, t): (c, t, role, text) for c, t, role, text in talks(4, 30)}.values())
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", some)
    rows = c.execute(f"select depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({trie.ORACLE})").fetchall()
    assert sorted(rows, key=str) == walked(some)
