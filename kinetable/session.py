"""Session helpers: reliable checkpoints and shared scratch folders."""

import tempfile
import threading
import uuid
from contextlib import contextmanager

CHECKPOINT_CONF = "spark.checkpoint.dir"
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of rows that go to a Python worker at once; a longer single row goes alone.
BATCH_BYTES = 4 << 20


def small_batches(spark):
    """Let the session hand rows to Python workers in batches of bounded size, whatever the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark):
    """The folder the cluster names for checkpoints.

    Only a local session without a setting gets a temporary folder; on a
    cluster a missing setting is an error, because executors on other machines
    could not read what one of them wrote.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="kinetable-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


releasing, release_lock = [], threading.Lock()


@contextmanager
def shuffles_released(spark):
    """Queries made and run inside give up their shuffle files when they end, and not when the driver collects garbage.

    For queries that run once.  May be entered by several threads of a session; the last one to leave restores the setting.
    """
    with release_lock:
        releasing.append(spark.conf.get(RELEASE_CONF))
        spark.conf.set(RELEASE_CONF, "true")
    try:
        yield
    finally:
        with release_lock:
            before = releasing.pop()
            if not releasing:
                spark.conf.set(RELEASE_CONF, before)


def checkpointed(df):
    """Materialise ``df`` in the shared folder and cut its lineage; its shuffle files are let go."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df, name):
    """``df`` as compressed columns in the shared folder; its shuffle files are let go."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, name))


def stored_path(df, name):
    """The folder of ``stored``, for streams and others who read files."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return path


def scratch_path(spark, name):
    """A fresh path below the shared folder, for tables written by a job."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
