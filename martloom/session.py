"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session someone else made.
# forceOptimizeSkewedJoin: split a hot join key even where a later step could
# otherwise have reused the join's partitioning.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# A task holds its partition in sort buffers and up to five hash tables, some twenty times its compressed bytes.
TASK_BYTES, FILE_BYTES = 16 << 20, 64 << 20
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FINER = 8  # partitions dealt for each of spark.sql.shuffle.partitions; small ones are merged up to TASK_BYTES


def tune(spark: SparkSession) -> SparkSession:
    """Settings the jobs count on. An advisory size that the caller has set is left alone."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    spark.conf.set(INITIAL, str(FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if spark.conf.get(ADVISORY).rstrip("b") == str(FILE_BYTES):  # Spark's default
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    return spark


@contextmanager
def file_sized(spark: SparkSession):
    """For writes whose shuffled partitions become files: these are larger than a task's share of a join."""
    before = spark.conf.get(ADVISORY)
    if before == str(TASK_BYTES):
        spark.conf.set(ADVISORY, str(FILE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ADVISORY, before)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What a job shuffles inside goes from disk when the job ends, not when its frame is collected as garbage.

    For chains of jobs that write tables and read those. A frame executed again inside shuffles again.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("martloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def job_session() -> SparkSession:
    """The session of a job started by its command line.

    Sets neither master nor sizes, so what spark-submit was given holds; plain
    ``python`` gets PySpark's own local default.
    """
    return tune(SparkSession.builder.appName("martloom").getOrCreate())


_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and tasks share one disk, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_ROOT[app]


_SCOPE: ContextVar[str] = ContextVar("scratch_scope", default="shared")


_KEPT_UNTIL_EXIT: set[str] = set()


def _scratch_home(spark: SparkSession) -> str:
    home = f"{scratch_root(spark).rstrip('/')}/martloom-{spark.sparkContext.applicationId}"
    if home not in _KEPT_UNTIL_EXIT:
        # What is still staged when the session ends goes with it.
        _KEPT_UNTIL_EXIT.add(home)
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return f"{home}/{_SCOPE.get()}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root, unique to this application."""
    return f"{_scratch_home(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_STEPS: dict[str, list[tuple[int, str]]] = {}


@contextmanager
def scratch_step(spark: SparkSession, number: int):
    """Scope of one step of a chain whose steps each read what the step before has written.

    When a step begins, what steps of lower number staged is not read any more
    and is deleted. What the last step staged goes with the session.
    """
    done = _STEPS.setdefault(spark.sparkContext.applicationId, [])
    for step in [s for s in done if s[0] < number]:
        _delete(spark, step[1])
        done.remove(step)
    token = _SCOPE.set(f"step-{uuid.uuid4().hex}")
    done.append((number, _scratch_home(spark)))
    try:
        yield
    finally:
        _SCOPE.reset(token)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables staged inside belong to this scope and are deleted at its end.

    For jobs that write their results elsewhere; frames built on the staged
    tables do not outlive the scope. What has to is staged by the function given,
    ``keep(df, name)``, in the scope around this one.
    """
    outer = _scratch_home(spark)
    token = _SCOPE.set(f"scope-{uuid.uuid4().hex}")
    try:
        yield lambda df, name: _written(df, f"{outer}/{name}-{uuid.uuid4().hex}")
    finally:
        _delete(spark, _scratch_home(spark))
        _SCOPE.reset(token)


def stage(df, name: str):
    """Write ``df`` once and read it back.

    Cuts lineage and pins values that depend on a physical layout. The copy
    lives in the shared folder, so losing executors does not lose it.
    """
    return _written(df, scratch_path(df.sparkSession, name))


def _written(df, path: str):
    # Read once or twice and then deleted: small on disk counts more than fast to write.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
