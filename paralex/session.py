"""Session building and the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths that ``fresh_path`` made outside of any scope, since the session began or ``clear_written`` ran.
_made: list[str] = []
#: The paths of the scope that this thread is in.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; ``master`` and sizes are the cluster's if not given."""
    builder = (
        SparkSession.builder.appName("paralex")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder of this machine in
    a local session and an error on a cluster, whose machines share no such folder."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return str(context.getCheckpointDir().get())


def fresh_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    held = _scope.get()
    (_made if held is None else held).append(path)
    return path


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The paths that this thread makes in the block, for ``clear_written``.

    What other threads make meanwhile isn't among them, so whoever clears a scope deletes
    its own tables only.
    """
    held: list[str] = []
    token = _scope.set(held)
    try:
        yield held
    finally:
        _scope.reset(token)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe
    from lost executors."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def clear_written(spark: SparkSession, held: list[str] | None = None, keep: DataFrame | None = None) -> None:
    """Delete what was written below the shared folder: the paths ``held`` of a scope, else
    those made outside of any; the files that ``keep`` reads stay.

    Results that still read the rest must have been stored before.
    """
    paths = _made if held is None else held
    needed = " ".join(keep.inputFiles()) if keep is not None else ""
    gone = [p for p in list(paths) if p.rsplit("/", 1)[-1] not in needed]
    _remove(spark, gone)
    paths[:] = [p for p in paths if p not in gone]
