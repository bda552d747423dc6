"""Operator 13, approximate nearest neighbours by learned partitions.

Method: a bounded sample of distinct vectors (SAMPLE at most, chosen by hash) gets its exact
neighbour graph, computed by tasks against the broadcast sample. The graph is cut into balanced
parts by recursive bisection: the sign-split of a smoothed eigenvector at its median, then swaps of
equally many nodes that lower the cut. A small network (one hidden layer) learns the parts of a
vector's neighbours from the vector. Every row is indexed under its most probable part; a query goes
to its most probable parts until their probability exceeds a mass, and is reranked exactly there.
The mass is measured, not guessed: on a tenth of the sample that neither the cut nor the network has
seen, it is the least that finds RECALL of the neighbours.

Equal vectors are one entry with their k + 1 least ids, which is all that any list of k neighbours
can need; so a vector that a third of the rows share is one row. A part larger than a block is
several groups, and so are its queries; no group exceeds BLOCK_BYTES on either side.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, and neither do rows without an id nor vectors of another length than the commonest one (the
longer one on a tie); ties go to the smaller id; a repeated row counts once; rows with the query's
id are not its neighbours; fewer candidates give fewer rows; an empty table gives none; extra
columns are not read. Few vectors make one part, which is searched whole. The parts are at most
MOST_PARTS, so beyond MOST_PARTS * PART_ROWS distinct vectors they grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

NEIGHBOURS = 10
PART_ROWS = 1024
MOST_PARTS = 256
SAMPLE = 1 << 14
SAMPLE_BYTES = 64 << 20
RECALL = 0.97
HIDDEN = 128
DEGREE = 10
BLOCK_BYTES = 8 << 20
EPOCHS = 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """Which half each node goes to (sizes differ by one at most); a, b: edges between places in nodes, both ways."""
    n, half = len(nodes), len(nodes) // 2
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    root = np.sqrt(degree)
    trivial = root / np.linalg.norm(root)
    f = rng.standard_normal(n)
    for _ in range(rounds):  # power rounds of the walk's matrix, without its first eigenvector
        f = f / 2 + np.bincount(a, weights=f[b] / root[b], minlength=n) / root / 2
        f -= trivial * (trivial @ f)
        f /= np.linalg.norm(f) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(f / root, kind="stable")[half:]] = True
    best, cut = side.copy(), np.count_nonzero(side[a] != side[b])
    for _ in range(20):
        outward = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=n)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-outward[one], kind="stable")], two[np.argsort(-outward[two], kind="stable")]
        m = min(len(one), len(two))
        gain = np.flatnonzero(outward[one[:m]] + outward[two[:m]] > 0)
        swap = max(1, len(gain) // 4)
        if not len(gain):
            break
        side[one[:swap]], side[two[:swap]] = False, True
        now = np.count_nonzero(side[a] != side[b])
        if now < cut:
            best, cut = side.copy(), now
    return best


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """The part of each node of a neighbour graph (row i: neighbours of i, -1: none); parts is a power of two."""
    n, rng = len(graph), np.random.default_rng(seed)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        new = np.zeros(n, np.int64)
        for p in range(size):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (part[a] == p) & (part[b] == p)
            new[nodes] = 2 * p + bisect(nodes, place[a[inside]], place[b[inside]], rng)
        part, size = new, 2 * size
    return part


@dataclass
class Router:
    """The classifier, and the mass of probability that a query follows."""

    parts: int
    mass: float = 1.0
    weights: tuple[np.ndarray, ...] = ()

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(vectors), 1))
        mean, spread, w1, b1, w2, b2 = self.weights
        hidden = np.maximum((vectors - mean) / spread @ w1 + b1, 0)
        out = hidden @ w2 + b2
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return self.probabilities(vectors).argmax(1)

    def routes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of the parts that each vector is searched in."""
        p = self.probabilities(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        row, rank = np.nonzero(np.cumsum(ranked, 1) - ranked <= self.mass)
        return row, order[row, rank]


def train(vectors: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, seed: int = 1) -> Router:
    """A network from a vector to the parts of itself and its neighbours, by Adam over EPOCHS rounds."""
    rng, n = np.random.default_rng(seed), len(vectors)
    mean, spread = vectors.mean(0), vectors.std(0) + 1e-12
    x = ((vectors - mean) / spread).astype(np.float32)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.arange(n), part), 1)
    row, at = np.nonzero(graph >= 0)
    np.add.at(target, (row, part[graph[row, at]]), 1)
    target /= target.sum(1, keepdims=True)
    shape = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,))
    w = [rng.standard_normal(s).astype(np.float32) * np.float32((2 / s[0]) ** 0.5 if len(s) == 2 else 0) for s in shape]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(EPOCHS):
        rate = 2e-3 * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(n)
        for begin in range(0, n, 256):
            take = shuffled[begin : begin + 256]
            xb = x[take]
            hidden = np.maximum(xb @ w[0] + w[1], 0)
            out = hidden @ w[2] + w[3]
            out = np.exp(out - out.max(1, keepdims=True))
            error = (out / out.sum(1, keepdims=True) - target[take]) / len(take)
            back = error @ w[2].T * (hidden > 0)
            step += 1
            for v, g, m1, m2 in zip(w, (xb.T @ back, back.sum(0), hidden.T @ error, error.sum(0)), first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Router(parts, 1.0, (mean, spread, *(v.astype(np.float64) for v in w)))


def _graph(spark: SparkSession, sample: np.ndarray, degree: int) -> np.ndarray:
    """The nearest others of each row of the sample, by tasks of 256 rows against the broadcast sample."""
    n, step = len(sample), 256
    shared = spark.sparkContext.broadcast(sample.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        norms = (x * x).sum(1)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                at = np.arange(block * step, min(n, (block + 1) * step))
                d = norms - 2 * x[at] @ x.T
                d[np.arange(len(at)), at] = np.inf
                near = np.argpartition(d, degree, 1)[:, :degree]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([near.astype(np.int32).tobytes()])], ["block", "near"])

    blocks = -(-n // step)
    found = spark.range(0, blocks, 1, blocks).mapInArrow(run, "block long, near binary").collect()
    shared.destroy()
    return np.concatenate([np.frombuffer(r.near, np.int32).reshape(-1, degree) for r in sorted(found, key=lambda r: r.block)]).astype(np.int64)


def fit(entries: DataFrame, n: int, dim: int, part_rows: int = PART_ROWS, sample: int = SAMPLE, recall: float = RECALL) -> Router:
    """The router of a stored table of n distinct vectors (column vector), fitted on a sample of them."""
    parts = 1
    while parts < MOST_PARTS and n > parts * part_rows:
        parts *= 2
    size = min(n, sample, SAMPLE_BYTES // (8 * dim))
    while parts > 1 and size < 32 * parts:
        parts //= 2
    if parts == 1:
        return Router(1)
    drawn = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    rows = entries.filter(drawn < int((1 << 30) * size / n)).select("vector").toArrow()  # about `size` rows: the hash is even
    vectors = _matrix(rows.column("vector"))
    vectors = vectors[np.lexsort(vectors.T[:4])]  # whatever order they came in
    degree = min(DEGREE, len(vectors) - 1)
    graph = _graph(entries.sparkSession, vectors, degree)
    held = np.zeros(len(vectors), bool)
    held[np.random.default_rng(2).permutation(len(vectors))[: len(vectors) // 10]] = True
    number = np.cumsum(~held) - 1
    inner = np.where(held[graph], -1, number[graph])
    part = balanced_parts(inner[~held], parts)
    router = train(vectors[~held], inner[~held], part, parts)
    # how much probability stands before the part of each neighbour of the rows held back
    p = router.probabilities(vectors[held])
    home = router.home(vectors[~held])
    row, at = np.nonzero(inner[held] >= 0)
    own = p[row, home[inner[held][row, at]]]
    before = np.where(p[row] > own[:, None], p[row], 0).sum(1)
    router.mass = float(np.quantile(before, recall)) + 1e-9 if len(before) else 1.0
    return router


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, distance) of the k nearest ids; vector i has ids[bounds[i]:bounds[i + 1]].

    A product of matrices finds who may be among them; distances are taken from the differences.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norms, own = (vectors * vectors).sum(1), (queries * queries).sum(1)
        rough = own[:, None] + norms - 2 * queries @ vectors.T
        if k < len(vectors):
            bound = np.partition(rough, k - 1, 1)[:, k - 1] + 1e-12 * (own + norms.max())
            row, at = np.nonzero(~(rough > bound[:, None]))
        else:
            row, at = np.nonzero(np.ones(rough.shape, bool))
        exact = np.sqrt(((queries[row] - vectors[at]) ** 2).sum(1))
    many = bounds[at + 1] - bounds[at]
    which = np.repeat(np.arange(len(row)), many)
    place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[at], many)
    row, exact, found = row[which], exact[which], ids[place]
    order = np.lexsort((found, exact, row))
    row, exact, found = row[order], exact[order], found[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], found[rank < k], exact[rank < k]


def _blocks(df: DataFrame, limit: int) -> dict[int, int]:
    """Groups of each part, none above the limit in the mean; parts are MOST_PARTS at most."""
    return {r.part: -(-r["count"] // limit) for r in df.groupBy("part").count().collect()}


def _of(parts: int, table: dict[int, int]) -> Column:
    return F.element_at(F.array(*[F.lit(table.get(p, 0)) for p in range(parts)]), F.col("part") + 1)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, part_rows: int = PART_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (the same columns) its k nearest found among vectors."""
    spark = vectors.sparkSession
    named = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = named(vectors).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths.dim
    rows = named(vectors).filter(F.size("vector") == dim)
    by_id = Window.partitionBy("vector").orderBy("id")
    least = rows.select("id", "vector", F.rank().over(by_id).alias("at")).filter(F.col("at") <= k + 1)
    entries = materialise(least.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")), "entries")
    router = fit(entries, entries.count(), dim, part_rows, recall=recall)
    shared = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = shared.value.home(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("ids"), pa.array(home.astype(np.int32))], ["vector", "ids", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, part = shared.value.routes(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("vector", "query")), pa.array(part.astype(np.int32))], ["vector", "query", "part"])

    limit = max(64, BLOCK_BYTES // (8 * dim))
    indexed = materialise(entries.mapInArrow(place, "vector array<double>, ids array<long>, part int"), "indexed")
    asked_rows = named(queries).filter(F.size("vector") == dim)
    asked = materialise(asked_rows.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    routed = materialise(asked.mapInArrow(route, "vector array<double>, query long, part int"), "routed")
    sizes, wanted = _blocks(indexed, limit), _blocks(routed, limit)
    share = lambda n: F.pmod(F.xxhash64("vector"), n).cast("int")  # noqa: E731  keys of one type on both sides
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = routed.filter(_of(router.parts, sizes) > 0).select("*", share(_of(router.parts, wanted)).alias("share"), each(_of(router.parts, sizes)).alias("block"))
    right = indexed.filter(_of(router.parts, wanted) > 0).select("*", share(_of(router.parts, sizes)).alias("block"), each(_of(router.parts, wanted)).alias("share"))

    def rerank(one: pa.Table, two: pa.Table) -> pa.Table:
        q, lists = _matrix(one.column("vector")), two.column("ids").combine_chunks()
        v, numbers = _matrix(two.column("vector")), one.column("query").to_numpy()
        ids, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        out = ([], [], [])
        if len(q) and len(v):
            step = max(1, (1 << 21) // len(v))
            for begin in range(0, len(q), step):
                row, found, score = nearest(q[begin : begin + step], v, ids, bounds, k + 1)
                for held, values in zip(out, (numbers[begin + row], found, score), strict=True):
                    held.append(values)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    keys = ["part", "block", "share"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query long, vec_id long, score double")
    best = met.select("*", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")).alias("at")).filter(F.col("at") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    # rows with one vector share one list, from which each leaves itself out
    answered = asked_rows.distinct().join(asked.join(lists, "query").select("vector", "near"), "vector")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose vec_id is divisible by 100, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
