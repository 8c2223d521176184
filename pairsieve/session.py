"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(
    app: str = "pairsieve", cpus: int | str = "*", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A session for tests and the local benchmark. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if shared:
        builder = builder.config(CHECKPOINT_KEY, shared)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local-mode session without the setting gets a temporary folder; a cluster without it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="pairsieve-")
    return _local_scratch[app]


_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder; ``clear_scratch`` deletes it."""
    path = f"{shared_folder(spark)}/pairsieve/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay as long as results may read them: until ``discard`` or ``clear_scratch``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables that no later job reads."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            _delete(table.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application has written to its scratch paths; results that still read them become invalid."""
    for path in list(_made.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
