"""Helpers that the operators share: table access, checkpoints and distributed components."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none, as in local tests, a temporary folder is chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lagoon-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: schemes of Hadoop's connectors that Arrow's file systems know by another name
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI that Arrow's file systems open: a bare path and ``file:/x`` are qualified as
    Hadoop would, object stores get Arrow's scheme. Raises ValueError for stores that Arrow lacks."""
    uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri()
    if uri.getScheme() is None:
        path, fs = _path(spark, folder)
        uri = fs.makeQualified(path).toUri()
    scheme, host, rest = uri.getScheme(), uri.getAuthority() or "", uri.getPath()
    scheme = _SCHEMES.get(scheme, scheme)
    if scheme not in ("file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss"):
        raise ValueError(f"no file system for {scheme}: {folder}")
    return f"{scheme}://{host}{rest}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package made, on whatever file system it is."""
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def whole_number(df: DataFrame, name: str) -> None:
    """Raises ValueError where a column's type is no whole number: its ids are written as such."""
    kind = df.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{name} must be whole numbers, not {kind}")


def bloom(hashes: DataFrame, n: int, most_bits: int = 1 << 27):
    """A function from a numpy array of 64-bit hashes to whether each may be in ``hashes``, whose only
    column has ``n`` of them; what is in it always may.

    Bits are set by tasks, a block of 2^15 to a row; the driver gets at most ``most_bits`` (16 MB).
    Beyond about ``most_bits / 8`` hashes it lets more through, so an exact join has to follow.
    """
    bits = 1 << 15
    while bits < 16 * n and bits < most_bits:
        bits <<= 1
    mask = np.uint64(bits - 1)

    def places(h: np.ndarray) -> np.ndarray:
        h = h.astype(np.int64).view(np.uint64)
        return np.stack([K.mix(h, 61 + k) & mask for k in range(4)]).astype(np.int64)

    def deal(batches):
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array((at & 32767).astype(np.int32))], names=["block", "place"])

    def fill(batches):
        held = np.zeros(1 << 15, np.uint8)
        last = None
        for batch in batches:
            blocks, spots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.flatnonzero(np.concatenate([blocks[1:] != blocks[:-1], [True]])) + 1 if len(blocks) else []
            begin = 0
            for end in ends:
                if last is not None and blocks[begin] != last:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([np.packbits(held).tobytes()])], names=["block", "bits"])
                    held[:] = 0
                last = int(blocks[begin])
                held[spots[begin:end]] = 1
                begin = end
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([np.packbits(held).tobytes()])], names=["block", "bits"])

    dealt = hashes.mapInArrow(lean(deal), "block long, place int")
    rows = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lean(fill), "block long, bits binary").collect()  # at most most_bits / 2^15 rows of 4 KB
    table = np.zeros(bits >> 3, np.uint8)
    for r in rows:
        table[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table)

    def may(h: np.ndarray) -> np.ndarray:
        at = places(h)
        return (shared.value[at >> 3] >> (7 - (at & 7)) & 1).all(0)

    return may


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    Catalyst may inline a projected column into a higher-order function, which would then evaluate
    it for every element; a lambda variable is bound once.
    """
    return F.transform(F.array(value), body)[0]


def _release() -> None:
    """Gives freed memory of this worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A ``mapInArrow`` function after which its worker, which Spark keeps for later tasks, is small
    again: an executor's limit counts what idle workers hold."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return go


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``(id, root)``; root is the smallest id.

    Alternates hooking (a label takes the smallest label next to it) with pointer jumping, so that
    rounds grow with the logarithm of the diameter. Every step is a shuffle on ids; each round is
    checkpointed in the shared folder. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    e = cut(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    done = None
    links = e
    parent = None  # (id, root) for every node seen so far
    for _ in range(max_rounds):
        # each node hooks to its smallest neighbour not above itself
        hook = cut(
            links.select(F.col("b").alias("id"), F.col("a").alias("p"))
            .groupBy("id").agg(F.min("p").alias("p"))
        )
        # pointer jumping until every node points at a node that points at none
        while True:
            up = hook.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
            jumped = cut(
                hook.join(up, hook.p == up._i, "left")
                .select("id", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved"))
            )
            hook = jumped.select("id", "p")
            if not jumped.where("moved").limit(1).count():
                break
        if parent is None:
            nodes = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
            parent = cut(nodes.join(hook, "id", "left").select("id", F.coalesce("p", "id").alias("root")))
        else:
            h = hook.select(F.col("id").alias("_i"), "p")
            parent = cut(parent.join(h, parent.root == h._i, "left").select("id", F.coalesce("p", "root").alias("root")))
        ha = hook.select(F.col("id").alias("_a"), F.col("p").alias("_pa"))
        hb = hook.select(F.col("id").alias("_b"), F.col("p").alias("_pb"))
        moved = (
            links.join(ha, links.a == ha._a, "left").join(hb, F.col("b") == F.col("_b"), "left")
            .select(F.coalesce("_pa", "a").alias("x"), F.coalesce("_pb", "b").alias("y"))
        )
        links = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not links.limit(1).count():
            done = parent
            break
    if done is None:
        raise RuntimeError("components did not settle")
    return done
