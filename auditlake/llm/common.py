"""Shared plumbing: the shared folder, materialised tables, Arrow chunking and components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 400


def tune(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent a local temporary folder is set, and only in local mode (as in
    tests): executors on other machines would not see it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditlake-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/auditlake/{uuid.uuid4().hex}/{name}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives executors."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # small row groups: a task holds one of them in memory while it writes
    df.write.option("parquet.block.size", str(8 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let the driver find unused shuffles now: their files go only when it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_in(keys: DataFrame, column: str, bits: int = 1 << 26):
    """A Column test on `column`, true for every value of keys' column and for few others.

    A bit map of fixed size (8 MB by default) over hashes of the values; with many more values
    than bits it lets more pass, and never fewer. The parts of the map are aggregated on the
    executors.
    """
    spark = keys.sparkSession
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    parts = keys.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("map"))
    table = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():
        table[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(bytes(row.map), np.uint8)
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")  # Arrow and not pandas: a worker holds 24 MB less
    def test(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return test(place)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about `limit` bytes of text (a longer row stands alone).

    At the end of a partition what the allocators hold unused goes back to the system, since the
    worker process lives on beside the executor's JVM.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)
        del batch
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def free_prefix(base: str, columns: list[str]) -> str:
    """A prefix for working columns that no column of the input begins with."""
    while any(c.lower().startswith(base) for c in columns):
        base = f"_{base}"
    return base


def table_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Neighbours of a node at most that meet in one task; HUBS: nodes that may have more.
HUB = 1024
HUBS = 1 << 14
#: Edges that a contracting task reads if files are smaller, and nodes that it holds at a time.
EACH = 1 << 14
HELD = 1 << 17


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a long, b long).

    Returns (node, root) for every node that has an edge; root is the component's smallest
    node. Alternating large-star and small-star steps (Kiveris et al., SoCC 2014) need a
    logarithmic number of rounds whatever the diameter. Before each round every task contracts
    the edges that it reads to stars, so that a small graph, which few tasks read, takes one round
    or two. Each round is written to the shared folder. Neighbour lists are never collected: both
    steps use a minimum per node and a join, and a hub's rows stay where they are (see
    _with_least). Rounds end when every node has one edge, to a node that has none.
    """
    spark = edges.sparkSession
    current, path = stored(contracted(edges.select("a", "b"), edges.count()), "edges")
    for _ in range(max_rounds):
        n, stars = _stars(current)
        if stars:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = _with_least(both, least, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path = stored(large.filter("a <> b").distinct(), "large")
        # small star: smaller neighbours and the node itself are linked to the least neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (
            _with_least(large, low, large.count())
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        small, small_path = stored(small, "small")
        remove(spark, path)
        remove(spark, large_path)
        current, path = stored(contracted(small, n), "edges")
        remove(spark, small_path)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def contracted(edges: DataFrame, n: int) -> DataFrame:
    """Edges (a, b), about n, with the same components: those that a task reads become stars, each node linked to its smallest."""
    return edges.coalesce(max(1, -(-n // EACH))).mapInArrow(_contract, "a long, b long")


def _contract(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, root) for x in parent if (root := find(x)) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([r for _, r in found], pa.int64())})

    for batch in batches:
        for begin in range(0, batch.num_rows, max(1, held // 4)):
            part = batch.slice(begin, max(1, held // 4))
            for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) >= held:
                yield stars()
                parent.clear()
    yield stars()


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (a, b; n of them) with m of their a, from least (a, m, n: rows of a).

    Nodes with many rows are few, at most n / most of them by counting, and reach the rows by a broadcast; so
    no key of the shuffled join has more than `most` rows.
    """
    most = max(HUB, -(-n // HUBS))
    hubs = F.broadcast(least.filter(F.col("n") > most).select("a", F.col("m").alias("hub")))
    found = rows.join(hubs, "a", "left")
    rest = found.filter("hub is null").select("a", "b").join(least.filter(F.col("n") <= most).select("a", "m"), "a")
    return found.filter("hub is not null").select("a", "b", F.col("hub").alias("m")).unionByName(rest)


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether every a has one edge and no b has any."""
    ends = edges.select("a", F.lit(1).alias("own"), F.lit(0).alias("other")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("own"), F.lit(1).alias("other")))
    nodes = ends.groupBy("a").agg(F.sum("own").alias("own"), F.max("other").alias("other"))
    n, bad = nodes.agg(F.coalesce(F.sum("own"), F.lit(0)), F.count_if((F.col("own") > 1) | ((F.col("own") > 0) & (F.col("other") > 0)))).first()
    return n, bad == 0
