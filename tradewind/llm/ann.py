"""Nearest neighbours by additive quantisation.

Every vector is the sum of one codeword from each of several full-dimensional codebooks, found by beam search, and
what the sum leaves is its residual. A query's inner products with all codewords make a lookup table; a vector's
score is the sum of its codewords' entries. By the inequality of Cauchy and Schwarz this score is off by at most the
residual's norm times the query's: the vectors that this bound lets be among a query's nearest, however many, are
ranked by their exact inner products, so that none is missed on whatever rows. Blocks of codes stay where they are
and queries pass by them in blocks, so that no task's memory grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, staged

#: Vectors that codebooks are learnt from, at most.
SAMPLE = 8192
BOOKS, WORDS, BEAM, STEPS = 28, 256, 2, 8
#: Vectors to a block of codes, and to a block of queries; queries that are scored at once.
CODES, QUERIES, LANES = 8192, 1024, 128


@dataclass
class Codebooks:
    books: np.ndarray  # books, words, dimensions

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The codes of the rows of x: of the sums that beam search finds, the closest to each row."""
        n, k = len(x), self.books.shape[1]
        left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            # |left - word|^2, of which |left|^2 matters between the paths of a beam
            cost = (left**2).sum(-1)[:, :, None] - 2 * left @ book.T + (book**2).sum(-1)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            path, word = np.divmod(best, k)
            left = np.take_along_axis(left, path[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), (left**2).sum(-1).argmin(1)]

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """The squared norms of the sums that codes stand for."""
        return (sum(book[codes[:, j]] for j, book in enumerate(self.books)) ** 2).sum(-1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with all codewords."""
        return np.einsum("qd,mkd->mqk", queries, self.books, optimize=True).astype(np.float32)

    def scores(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The approximate inner products of queries, by their tables, and coded vectors."""
        out = np.zeros((len(codes), tables.shape[1]), np.float32)
        part = np.empty_like(out)
        for j, table in enumerate(tables):
            out += np.take(np.ascontiguousarray(table.T), codes[:, j], axis=0, out=part, mode="clip")
        return np.ascontiguousarray(out.T)


def learn_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, steps: int = STEPS, seed: int = 0) -> Codebooks:
    """Codebooks for the rows of x: each is k-means of what the ones before leave."""
    rng = np.random.default_rng(seed)
    left, found = x.astype(np.float32), []
    words = max(1, min(words, len(x)))
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(steps):
            own = ((book**2).sum(1) - 2 * left @ book.T).argmin(1)
            sizes = np.bincount(own, minlength=words)
            sums = np.stack([np.bincount(own, left[:, d], words) for d in range(left.shape[1])], axis=1)
            book = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], book).astype(np.float32)
        left = left - book[((book**2).sum(1) - 2 * left @ book.T).argmin(1)]
        found.append(book)
    return Codebooks(np.stack(found))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, some component not 0, none null or beyond all bounds."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def exact_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Inner products of the rows of q and x, or squared distances, negated: summed in double precision, first component first."""
    total = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for a, b in zip(q.T, x.T, strict=True):
            total += a * b if metric == "ip" else (a - b) * (a - b)
    return total if metric == "ip" else -total


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v.values) for v in column]) if len(column) else np.zeros((0, 0))


def _blocks(df: DataFrame, size: int, key: Column, schema: str, pack) -> DataFrame:
    """Rows of a table in about as many groups as blocks of `size` need, each packed into one row."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("block", F.pmod(key, F.lit(n))).groupBy("block").applyInArrow(pack, schema)


def best_of_block(coder: Codebooks, centre: np.ndarray, scale: float, queries: np.ndarray, nodes: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray, n: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, node, score) of the n nearest of a block's vectors to each query, exactly; and ties with the last.

    x * scale is centre, plus the sum that its codes stand for, plus a residual whose norm is at most left. The best by
    lookup tables are multiplied out, and the worst of them is a bar that any other has to reach by its bound.
    """
    rows, places = [], []
    n = min(n, len(nodes))
    scaled = x * scale
    lengths = np.linalg.norm(scaled, axis=1)
    reach = np.abs(coder.books).max((1, 2)).sum() * np.sqrt(x.shape[1])  # no sum of codewords is longer
    off = left + 4e-7 * (x.shape[1] + len(coder.books)) * reach + 1e-9 * lengths
    for k in range(0, len(queries), LANES):
        size = np.abs(queries[k : k + LANES]).max(1, keepdims=True)
        unit = queries[k : k + LANES] / size
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        unit /= norm
        norms, shifts = (norm * size * scale)[:, 0], unit @ centre
        for i, near in enumerate(coder.scores(coder.tables(unit.astype(np.float32)), codes)):
            # In units of the query's norm: q x, or q x - |x|^2 / 2, which orders like the distance.
            less = lengths**2 / (2 * norms[i]) if metric == "l2" else None
            near, slack = near + shifts[i], 1e-9 * (lengths.max() + norms[i])
            if metric == "l2":
                near, slack = near - less, slack + 1e-9 * less
            seeds, bound = np.argpartition(-near, n - 1)[:n], near + off
            bar = (scaled[seeds] @ unit[i] - (less[seeds] if metric == "l2" else 0)).min()
            may = np.flatnonzero(~(bound < bar - 2 * slack))
            s = scaled[may] @ unit[i] - (less[may] if metric == "l2" else 0)
            bar = s[np.argpartition(-s, n - 1)[n - 1]]
            may = may[~(s < bar - 2 * (slack[may] if metric == "l2" else slack))]
            rows.append(np.full(len(may), k + i))
            places.append(may)
    at, place = np.concatenate(rows), np.concatenate(places)
    return at, nodes[place], exact_scores(queries[at], x[place], metric)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, metric: str = "ip") -> DataFrame:
    """(query_id, rank, id, score): the k nearest vectors of each query row, by inner product in double precision.

    With metric "l2", nearness is the squared distance, negated. The result is exact.

    is_query: a condition on id_col. A query's candidates are all rows but itself; ties go to the smaller id. Copies
    of a vector are coded and scored once, and each keeps its k + 1 smallest ids, which are all that can be among a
    query's nearest. Codebooks are learnt from at most `sample` distinct vectors, drawn by a hash, which steers the
    work, not the result; all vectors are coded. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do those with a null id or of another length than the most frequent one; rows that
    repeat an id count once, with one of their vectors. Fewer than two vectors give an empty result; further columns
    are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.max(F.struct("v", "asks")).alias("r")).select("id", "r.v", "r.asks")
    rows = staged(rows, "vectors")
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], result)
    rows = rows.where(F.size("v") == length.n)

    place = Window.partitionBy("v").orderBy("id")
    members = rows.select("v", "id").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    members = staged(members.withColumn("node", F.min("id").over(Window.partitionBy("v"))), "members")
    nodes = members.where("place = 1").select("node", "v")

    # A power of two, so that components are at most 1 in single precision and scaling is exact.
    largest = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scale = 2.0 ** -np.clip(np.frexp(largest)[1], -1000, 1000)
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).collect()  # at most `sample` vectors
    drawn = np.array([r.v for r in sorted(drawn, key=lambda r: r.node)]) * scale
    centre = drawn.mean(0)
    coder = learn_codebooks((drawn - centre).astype(np.float32))
    spread = F.xxhash64("node")

    def pack_codes(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x, codes, left = [], [], []
        for part in table.to_batches(2048):
            x.append(_matrix(part.column("v")))
            part = x[-1] * scale - centre
            codes.append(coder.encode(part.astype(np.float32)))
            for j, book in enumerate(coder.books):
                part -= book[codes[-1][:, j]]
            left.append(np.linalg.norm(part, axis=1) * (1 + 1e-9))
        parts = {"ids": np.asarray(table["node"]), "x": np.concatenate(x), "codes": np.concatenate(codes), "left": np.concatenate(left)}
        return pa.table({"shard": [key[0].as_py()]} | {c: [v.tobytes()] for c, v in parts.items()})

    def pack_queries(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = np.concatenate([_matrix(part.column("v")) for part in table.to_batches()])
        return pa.table({"part": [key[0].as_py()], "ids": [np.asarray(table["id"]).tobytes()], "x": [x.tobytes()]})

    codes = staged(_blocks(nodes, CODES, spread, "shard long, ids binary, x binary, codes binary, left binary", pack_codes), "codes")
    asking = rows.where("asks").select("id", "v")
    asked = staged(_blocks(asking, QUERIES, F.xxhash64("id"), "part long, ids binary, x binary", pack_queries), "queries")
    shards = codes.agg(F.max("shard")).first()[0] or 0
    passing = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long"))).alias("shard"), "part", "ids", "x")
    both = codes.withColumn("part", F.lit(-1).cast("long")).unionByName(passing, allowMissingColumns=True).select("shard", "part", "ids", "x", "codes", "left")
    both = both.repartitionByRange(shards + 1, "shard").sortWithinPartitions("shard", "part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of codes comes first, then all blocks of queries, one after another."""
        shard, block = None, ()
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["x"], float).reshape(len(ids), -1)
                if r["part"] < 0:
                    shard, block = r["shard"], (ids, x, np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["left"], float))
                elif r["shard"] == shard:
                    at, found, s = best_of_block(coder, centre, scale, x, *block, k + 1, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(s)], ["query_id", "node", "score"])

    found = staged(bound_batches(both).mapInArrow(score, "query_id long, node long, score double"), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    top = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    full = top.join(members.select("node", "id"), "node").where("id <> query_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
