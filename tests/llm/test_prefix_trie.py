import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tradewind.llm import prefix_trie
from tradewind.llm.queries import op11_prefix_trie

LOG = "conv_id long, turn long, role string, text string, depth string"


def brute_trie(paths):
    """{(turns of the node): row} of paths, {conv_id: list of (role, text)}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = {}
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = {k for k in below if len(k) == len(key) + 1}
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below) for k in below)
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(key))
        out[key] = (min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids), leaves, saved, ends)
    return out


def rows_of(nodes):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, ",".join(r.ends)) for r in nodes.collect())


def by_path(paths):
    key = lambda r: tuple(x if x is not None else -1 for x in r)
    return sorted(brute_trie(paths).values(), key=key)


def some_paths(seed, convs=40):
    draw = random.Random(seed)
    said = [("user", "a b"), ("assistant", "c"), ("user", ""), ("", "d  e\nf"), ("user", "é g")]
    paths = {c: [draw.choice(said[: draw.choice([1, 2, 5])]) for _ in range(draw.choice([0, 1, 2, 3, 7]))] for c in range(convs)}
    return paths | {convs + k: paths[convs // 2] for k in range(convs)} | {-3: [("x", "y")] * 9, 1000: [("x", "y")] * 9 + [("only", "here")]}


def table(spark, paths):
    rows = [(c, k, r, t, "clash") for c, path in paths.items() for k, (r, t) in enumerate(path)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, LOG), spark.createDataFrame([(c,) for c in paths], "conv_id long")


@pytest.mark.parametrize(("seed", "chunk", "single"), [(1, 1024, None), (2, 2, None), (3, 3, False)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, single):
    """Also in small chunks, and when the sketch proves nothing."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "LIST", 7)
    if single is False:
        monkeypatch.setattr(prefix_trie, "_surely_single", lambda prefixes, cells: F.lit(False))
    paths = some_paths(seed)
    turns, ids = table(spark, paths)
    got = rows_of(prefix_trie.trie_of(prefix_trie.turn_keys(turns), ids, cells=1 << 14))
    assert [tuple(x if x is not None else -1 for x in r) for r in got] == [tuple(x if x is not None else -1 for x in r) for r in by_path(paths)]


def test_odd_rows(spark):
    rows = [
        (1, 5, "user", "last", "x"),
        (1, None, None, None, "x"),
        (1, 2, "user", "same", "x"),
        (1, 2, "user", "same", "x"),
        (2, None, "", "", "x"),
        (None, 1, "user", "lost", "x"),
        (3, 1, "user", "word " * 100_000, "x"),
    ]
    got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, LOG)))
    paths = {1: [("", ""), ("user", "same"), ("user", "same"), ("user", "last")], 2: [("", "")], 3: [("user", "word " * 100_000)]}
    assert got == sorted(brute_trie(paths).values(), key=lambda r: r[:2])
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame([], LOG))) == []
    ties = [(c, 1, r, t, "") for c in (1, 2) for r, t in [("b", "x"), ("a", "y"), ("a", "z")][:: 1 if c == 1 else -1]]
    assert {r[3] for r in rows_of(prefix_trie.prefix_trie(spark.createDataFrame(ties, LOG)))} == {2}


def test_query(spark, tmp_path):
    draw = random.Random(5)
    said = [("user", "hello there"), ("assistant", "yes"), (None, None)]
    rows = [(c, t, *draw.choice(said), "") for c in [*range(45), 60, 61] for t in range(draw.choice([1, 2, 6]))]
    spark.createDataFrame(rows, LOG).drop("depth").write.parquet(f"{tmp_path}/conversations.parquet")
    own = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: r[:2]):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + path[h:]
    want = sorted(tuple(-1 if x is None else x for x in (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest())) for r in brute_trie(paths).values())
    got = op11_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(tuple(-1 if x is None else x for x in (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in got) == want
