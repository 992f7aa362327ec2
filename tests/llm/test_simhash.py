import random
from itertools import combinations, product

import numpy as np
import pytest
import xxhash

from tradewind.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_components_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.id: r for r in S.simhash_components(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_links_of_many_close_fingerprints(spark):
    near = [x for x in range(1 << 12) if bin(x).count("1") % 2 == 0 and x % 3] + [1 << 40, (1 << 40) | (1 << 63) | 7]
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    got = {r.fp: r.component for r in S.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()}
    want = brute_components(signed, lambda a, b: (a ^ b) % (1 << 64) and ((a ^ b) % (1 << 64)).bit_count() <= 2)
    groups = {}
    for x, c in want.items():
        groups.setdefault(c, set()).add(x)
    have = {}
    for x, c in got.items():
        have.setdefault(c, set()).add(x)
    assert sorted(map(sorted, have.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600")
    sets = {r.doc_id: frozenset(S.shingle_set(r.text)) for r in docs.collect()}
    sets = {i: s for i, s in sets.items() if s}
    want = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    got = {r.id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert got == {i: c for i, c in want.items() if sizes[c] > 1}


def test_near_duplicates_of_block_edits(spark):
    """Whole blocks cut, appended or replaced, at similarities from 0.80 to 0.95: every pair is found."""
    rng, texts, n = random.Random(5), {}, 0
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    for length, share, kind in product((60, 150, 400), (0.80, 0.82, 0.85, 0.90, 0.95), ("cut", "append", "replace")):
        for _ in range(4):
            words = [word() for _ in range(length)]
            k = int(length * (1 - share) / (1 if kind != "replace" else 2)) - 2
            at = rng.randrange(length - max(k, 0))
            new = {"cut": words[: length - max(k, 0)], "append": words + [word() for _ in range(k)], "replace": words[:at] + [word() for _ in range(k)] + words[at + max(k, 0) :]}[kind]
            texts[n], texts[n + 1] = " ".join(words), " ".join(new)
            n += 2
    sets = {i: set(S.shingle_set(t)) for i, t in texts.items()}
    near = {i for i in range(0, n, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(near) > 140
    got = {r.id: r.component_id for r in S.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    print("found", len(near & got.keys()), "of", len(near))
    assert got == {i + d: i for i in near for d in (0, 1)}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_prefixes_of_similar_sets_meet(similarity):
    rng = np.random.default_rng(2)
    frequent, counts = np.arange(0, 60, 3), rng.integers(1, 5, 20)
    for _ in range(3000):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, 3) :], rng.integers(0, 60, rng.integers(0, 4))])).astype(np.int64)
        if len(b) and len(np.intersect1d(a, b)) >= similarity * len(np.union1d(a, b)):
            assert np.intersect1d(*(S.prefix(x, frequent, counts, similarity) for x in (a, b))).size


EDGE = [(1, None), (2, ""), (3, "a b c d e f g h"), (4, "A  b\nc d e f g h"), (4, "a b c d e f g h"), (None, "a b c d e f g h"), (5, "x " * 60_000)]


@pytest.mark.parametrize("f", [S.simhash_components, S.drop_near_duplicates])
def test_odd_rows(spark, f):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in EDGE], "doc_id long, text string, fp string, id string, component_id int")
    rows = f(df).collect()
    if f is S.simhash_components:
        assert len(rows) == len(EDGE)
        assert {(r.id, r.component_id) for r in rows} == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3), (5, 5)}
    else:
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 5]
        assert rows[0].__fields__ == df.columns
    assert f(df.limit(0)).collect() == []


def test_near_duplicates_come_from_fingerprints_first(spark, monkeypatch):
    """What deletion variants bring together is verified and then left out of the search by prefixes, which finds the rest."""
    calls, link = [], S.link_buckets

    def watched(indexes, verify, possible=None, known=None):
        checked = []
        out = link(indexes, lambda pairs: checked.extend(map(tuple, pairs.collect())) or verify(pairs), possible, known)
        calls.append((possible is not None, checked, {r.node: r.component for r in out.collect()}))
        return out

    monkeypatch.setattr(S, "link_buckets", watched)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    mixed = [" ".join(words), " ".join(words[:399]), " ".join(words[:330]), "else where is none of it"]
    same = "a a a a a a a a a a a a a a a a a a a a "
    mixed += [same + "one two three four five", same + "six seven eight nine ten"]  # equal fingerprints, not near copies
    prints = [S.fingerprint(t) for t in mixed]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[0] ^ prints[2]).bit_count() and prints[4] == prints[5]
    got = {r.id: r.component_id for r in S.near_duplicates(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    (by_prefix, checked, found), (then, rest, whole) = calls
    assert (by_prefix, then) == (False, True) and {(1, 0), (5, 4)} <= set(checked) and found == {0: 0, 1: 0}
    assert (1, 0) not in rest and whole == {0: 0, 1: 0, 2: 0}


def test_frequent_shingles_reach_the_driver_as_columns(spark, monkeypatch):
    """The same as by sorting all, but for ties in the last place, and no row object for each in the driver."""
    rng = random.Random(4)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    rows = [([v for k, v in enumerate(values) if k % (d + 1) == 0],) for d in range(30)]
    counts = {}
    for (row,) in rows:
        for v in row:
            counts[v] = counts.get(v, 0) + 1
    most = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: most.append(len(out := collect(self))) or out)
    sets = spark.createDataFrame(rows, "s array<long>")
    for limit in (0, 10, 700, 10_000):
        got = dict(zip(*(x.tolist() for x in S.frequent_shingles(sets, limit)), strict=True))
        assert all(counts[v] == n > 1 for v, n in got.items()) and list(got) == sorted(got)
        repeated = sorted((n for n in counts.values() if n > 1), reverse=True)
        assert abs(len(got) - min(limit, len(repeated))) <= 60
        assert all(v in got for v, n in counts.items() if n > 1 and n > min(got.values(), default=99))
    texts = [(k, " ".join(f"w{k % 5}x{i}" for i in range(900))) for k in range(40)]
    S.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert max(most) <= 40
