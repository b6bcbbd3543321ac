"""Session helper and the few plan-shaping utilities every job shares.

Only three things live here:

* ``get_session`` — a local session for tests/bench (UTC, AQE on, UI off).
* ``ensure_checkpoint_dir`` — read ``spark.checkpoint.dir`` from the session; set
  a scratch directory only when it is unset (tests).  Never a machine-local
  folder on a cluster: the cluster names the shared folder.
* ``bounded_broadcast`` — broadcast a *derived* table only after its row count
  and size were checked, with a plain (shuffle) join beyond the bound.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A derived side (bounds per area, encoder per area, cluster summary, ...) is
# broadcast only when it holds at most this many rows.  Beyond it the join
# falls back to a shuffle join, which AQE may still convert at runtime.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20


def get_session(app: str = "propwise", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: a cluster must name a folder that all its machines share")
        configured = tempfile.mkdtemp(prefix="propwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


# Row counts of stored tables written by ``materialize`` (path -> rows), measured by an
# Observation during the write itself (no extra job).
_STORED_ROWS: dict[str, int] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used at the table boundaries the application itself has (RawProperty, the
    clean tables): later jobs scan a plain columnar table with pushdown and
    column pruning instead of re-deriving it, and a lost executor only
    re-reads files.  Every call writes a fresh folder.  The row count is observed
    during the write and remembered for ``stored_row_bound``.
    """
    import uuid

    from pyspark.sql import Observation

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    obs = Observation(f"rows_{name}_{uuid.uuid4().hex[:6]}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    _STORED_ROWS[path] = int(obs.get["rows"])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain(path: str) -> str:
    """Path without scheme and with one leading slash (file:/x, file:///x and /x agree)."""
    p = path[len("file:"):] if path.startswith("file:") else path
    return "/" + p.lstrip("/")


def stored_row_bound(df: DataFrame) -> int | None:
    """Rows of the one stored table ``df`` reads, if it reads exactly one.

    A filter, projection or many-to-one lookup of that table has at most this many
    rows (and so at most this many distinct values in any column).  ``None`` when
    ``df`` reads anything else.
    """
    try:
        files = df.inputFiles()
    except Exception:
        return None
    owners = {p for f in files for p in _STORED_ROWS if _plain(f).startswith(_plain(p) + "/")}
    return _STORED_ROWS[owners.pop()] if files and len(owners) == 1 else None


def bounded_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``small`` only if its checked row count and size are within the bounds.

    ``small`` must be a derived aggregate (per area, per cluster, ...).  It is written, so the check and
    the join read the same rows and nothing stays in memory.
    """
    small = materialize(small, "bounded")
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of its files
    return F.broadcast(small) if (stored_row_bound(small) or 0) <= max_rows and size <= max_bytes else small


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy step at least one partition per core.

    Inputs that already arrive in as many file splits pass through untouched; a smaller one
    is round-robin repartitioned.  The size is the optimizer's estimate: nothing runs for it.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(target) if int(str(size)) < target * int(split) else df


#: Rows of one partition of a training frame, at most: a pass holds a partition and what it makes of it.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, columns: list[str], finish=lambda rows: rows) -> DataFrame:
    """``finish`` of rows that many passes read, over partitions that the cores set, and of ``DEALT_ROWS`` rows at most.

    Every pass sends the driver a result of each task, however few rows that has; a union or a shuffle
    before it would leave hundreds of tasks.  A large table keeps ``columns`` alone; a small one is spread as it is.
    """
    few = spread(df)
    if few is not df:
        return finish(few)
    rows = stored_row_bound(df)
    rows = df.count() if rows is None else rows
    return finish(df).select(*columns).repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS)))


def at_once(spark: SparkSession, steps: list, threads: int = 2) -> list:
    """Results of ``steps`` (functions of no argument), in their order, ``threads`` of them running at a time.

    Training sends many short jobs one after the other; those of two models fill each other's gaps.  More at
    once would hold more training frames in memory.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda step: step()), steps, 1)


def first_row(df: DataFrame) -> dict:
    """Fetch the single row of a global aggregate (a handful of scalars)."""
    row = df.limit(1).collect()
    return row[0].asDict() if row else {}
