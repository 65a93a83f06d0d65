"""Session defaults, table loading and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings scene_catalog cameras images masks "
    "gaussians features ablation_runs aux_files result_files mix_targets"
).split()


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE). On a cluster, use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the tables below ``root``; Parquet, so filters and columns reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset (tests, local runs) a temporary one is set once."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of this process's applications below the shared folder, removed when it ends.
_FOLDERS: dict[str, str] = {}


def _remove_folders() -> None:
    from fieldmill.sources.files import file_system

    for folder in _FOLDERS.values():
        try:
            system, place = file_system(folder)
            system.delete_dir(place)
        except (OSError, ValueError):
            pass  # never made, or on a file system that only the cluster reaches


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one. It goes when the driver's process ends; ``clear_scratch`` takes it away earlier."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        if not _FOLDERS:
            atexit.register(_remove_folders)
        _FOLDERS[app] = f"{shared_dir(spark)}/fieldmill-{app}"
    return _FOLDERS[app]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` and the queries have written so far: for long sessions, once their results are stored."""
    _delete(spark, scratch_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder, for a table that is written and read back."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a ``cut`` that no later step reads."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable for Python workers that don't have it on their path; once a session."""
    context = spark.sparkContext
    if not getattr(context, "_fieldmill_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="fieldmill-ship-")  # on the driver only; Spark sends the file
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "fieldmill.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, Path("fieldmill") / path.relative_to(root))
        context.addPyFile(str(target))
        context._fieldmill_shipped = True
    return spark
