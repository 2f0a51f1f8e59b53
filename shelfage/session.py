"""Session construction, the shared scratch location and the life of intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the reports rely on: AQE re-plans joins from runtime sizes (so a
# small filtered side is broadcast only once its real size is known), the
# session time zone keeps date arithmetic stable, and ANSI mode turns
# decimal overflow into an error instead of a silent NULL. The runtime Bloom
# filter of the orders that pass a selection is built whatever the size of
# the orders (its own size is bounded by Spark's maxNumBits), so that lines of
# other orders are dropped at the fact scan, before they are folded.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1024t",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows travel to Python workers in Arrow batches of about this many bytes (``bounded_batches``).
ARROW_BATCH_BYTES = 4 << 20

_open = threading.local()     # ``scopes``: the paths made in each open ``intermediates`` block of the thread


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "shelfage",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, unless the caller has set a bound.

    Spark counts 10000 rows a batch; of long texts or sets that is tens of MB, which a task holds in the executor's direct
    memory (while a buffer doubles, two of them, and its pools keep them) and once more in the Python worker. The
    bound is one of the session, as a lazy result is planned only when it is used.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Directory shared by all executors: the session's checkpoint dir.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; if it is unset there, this raises instead of guessing. Only a
    local-mode session (tests, a laptop) without the setting gets a private
    folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: shelfage writes intermediate tables "
                               "(bundle, order-id sets, exports) below it, so it must name a folder "
                               "shared by all executors")
        current = tempfile.mkdtemp(prefix="shelfage-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared directory (never reused).

    Inside an ``intermediates`` block it is removed when the block ends; otherwise it stays, as a lazy result may still read it.
    """
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    scopes = getattr(_open, "scopes", None)
    if scopes:
        scopes[-1].append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession, keep: Iterable[str] = ()) -> Iterator[list[str]]:
    """Removes the intermediate tables that calls inside the block make, when it ends (also when it fails).

    What the block computes has to be written or collected inside it: a result that is still lazy afterwards reads
    tables that are gone. Blocks nest; each path belongs to the innermost one. ``keep`` are paths to leave.
    """
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    made: list[str] = []
    _open.scopes.append(made)
    try:
        yield made
    finally:
        _open.scopes.remove(made)
        kept = set(keep)
        remove(spark, [p for p in made if p not in kept])


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes files or folders of any store that Spark reads; paths that do not exist are passed over."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders and files in a folder of any store that Spark reads; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
