"""Spark session helper.

Cluster settings win: this module only fills in values that are unset, so a job
submitted to a real cluster keeps its own `spark.checkpoint.dir`, shuffle
partition count and so on.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "panelrd", shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one (for tests) if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        b = SparkSession.builder.appName(app)
        if master:
            b = b.master(master)
        b = b.config("spark.ui.enabled", "false")
        if shuffle_partitions:
            b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = b.getOrCreate()
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    if is_local(spark):
        checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (local, local[n])."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (`spark.checkpoint.dir`).

    Only when the setting is absent and driver and executors are one local process
    (tests) a folder is made under the system temp dir; elsewhere that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="panelrd-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Materialise `df` in the checkpoint folder and return a DataFrame reading it.

    Used where a result is scanned several times by later passes (bandwidth
    selection); survives executor loss because the data live in shared storage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def save_shared(df, name: str):
    """Write `df` as a table in the checkpoint folder and return a DataFrame reading it.

    Unlike a checkpoint it forgets how `df` was partitioned, so that a join with it is an
    ordinary shuffle join, whose skewed partitions Spark can split.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.shared_path = path
    return found


def drop_shared(df) -> None:
    """Delete the table that `save_shared` wrote for `df`; nothing may read it afterwards."""
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df, mode: str = "persist"):
    """Materialise a DataFrame that several passes will scan; returns (df, release).

    "persist": MEMORY_AND_DISK cache (blocks lost with an executor are recomputed
    from lineage); "checkpoint": reliable checkpoint in `spark.checkpoint.dir`
    (lineage cut; survives executor loss without replaying upstream joins);
    "none": leave as is (a pruned columnar scan is cheaper to read again than to cache).
    """
    from pyspark import StorageLevel

    if mode == "none":
        return df, (lambda: None)
    if mode == "checkpoint":
        return cut_lineage(df), (lambda: None)
    if mode != "persist":
        raise ValueError("mode must be 'persist', 'checkpoint' or 'none'")
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    return p, p.unpersist


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


JIT_METHOD_LIMIT = "8000"


class jit_friendly:
    """Context manager for the estimators' own actions: generated methods above the
    JVM's JIT size limit (8000 bytecodes) are split back into per-operator code
    instead of running interpreted.  The caller's setting is restored when the
    last concurrent user leaves (actions may run from several threads)."""

    key = "spark.sql.codegen.hugeMethodLimit"
    _lock = threading.Lock()
    _depth: dict = {}
    _saved: dict = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        sid = id(self.spark)
        with self._lock:
            if self._depth.get(sid, 0) == 0:
                self._saved[sid] = self.spark.conf.get(self.key, None)
                self.spark.conf.set(self.key, JIT_METHOD_LIMIT)
            self._depth[sid] = self._depth.get(sid, 0) + 1
        return self

    def __exit__(self, *exc):
        sid = id(self.spark)
        with self._lock:
            self._depth[sid] -= 1
            if self._depth[sid] == 0:
                old = self._saved.pop(sid)
                if old is None:
                    self.spark.conf.unset(self.key)
                else:
                    self.spark.conf.set(self.key, old)
        return False
