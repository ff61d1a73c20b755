"""Shared pieces: scratch tables in the shared folder, salted attaches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space between words: space and tab to carriage return.
WS = r"[\x20\x09-\x0D]"
#: Rows up to which a per-key table may be broadcast (checked by a count first).
BROADCAST_ROWS = 20_000
#: Counted edges up to which one task (16 bytes an edge) finds the components; more go by rounds over all tasks.
ONE_TASK_EDGES = 1 << 20
#: Pieces into which the rows of one key are dealt before they meet a per-key table.
SALTS = 64


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="strandframe-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, as in
    tests, and an error on a cluster, whose machines would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


class Scratch:
    """Tables written below the shared folder to cut lineage; ``drop`` removes the ones no longer read, ``close`` all of them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandframe-{tag}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def close(self) -> None:
        self._remove(self.root)
        if self in _OPEN:
            _OPEN.remove(self)


_OPEN: list[Scratch] = []


@contextmanager
def scratch_scope():
    """Removes at its end all scratch tables that operators made within it; results must be used up by then."""
    before = list(_OPEN)
    try:
        yield
    finally:
        for s in [s for s in _OPEN if s not in before]:
            s.close()


def shuffle_parts(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt_of(*cols, salts: int = SALTS):
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def attach_by_key(rows: DataFrame, small: DataFrame, key: str, spread: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Left join of one-row-per-key ``small`` to ``rows`` that survives a key holding a third of all rows.

    ``rows`` are dealt to (key, salt); ``small`` is copied to the salts its key really has, at most
    ``SALTS`` rows a key. A null key attaches nothing. ``spread`` names the columns that make the salt;
    ``seen`` may give (key, spread) of the rows from a narrower table.
    """
    salted = rows.withColumn("_salt", salt_of(*spread))
    there = salted if seen is None else seen.withColumn("_salt", salt_of(*spread))
    there = there.where(F.col(key).isNotNull()).groupBy(key, "_salt").agg(F.lit(1).alias("_one")).drop("_one")
    return salted.join(there.join(small, key), [key, "_salt"], "left").drop("_salt")


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place in the component of each of ``n`` places, by edges (i, j): the roots of both ends are hooked to the
    smaller one, then every place follows its root, until no edge joins two roots."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return label
        for k in (i, j):
            np.minimum.at(label, label[k], low)
            np.minimum.at(label, k, low)
        while (label[label] != label).any():
            label = label[label]


def _union(batches):
    """(node, root) of the edges of a task."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    u, v = (table.column(k).to_numpy() for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = local_roots(at[: len(u)], at[len(u) :], len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[label], pa.int64())], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", a: str = "a", b: str = "b", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of long-valued ``edges``.

    Returns (node, root): root is the smallest node id of the component; only nodes with an edge to
    another node appear. Edges are counted first. Up to ``one_task`` of them fit one task, which ends the matter
    without a shuffle; more are contracted by ``star_rounds`` over all tasks.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = scratch.store(e.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), f"{tag}-0")
    if e.count() <= one_task:
        return e.coalesce(1).mapInArrow(_union, "node long, root long")
    return star_rounds(e, scratch, tag)


def star_rounds(e: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, root) by alternating large-star and small-star steps on the stored edges (u > v) named <tag>-0.

    Every step is a partial aggregate plus a salted attach, so a hub is dealt over many tasks; each round is
    written to the shared folder and the one before it is removed. A step keeps at most one edge per (node,
    smaller node), so the edge table never grows.
    """
    before, k = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = attach_by_key(both, least, "u", ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = attach_by_key(large, low, "u", ["v"]).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u"), F.col("_m").alias("v")))).alias("_p")
        )
        nxt = small.select("_p.u", "_p.v").where("u <> v").distinct()
        k += 1
        e2 = scratch.store(nxt, f"{tag}-{k}")
        now = e2.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(f"{tag}-{k - 1}")
        e = e2
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
