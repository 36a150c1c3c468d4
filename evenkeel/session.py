"""Session settings, the shared scratch folder, and this package's code on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that suit the operators on a cluster as well as on one machine. The number of
# shuffle partitions is left to adaptive execution, which merges small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where an aggregation on the join's keys then needs a shuffle more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "evenkeel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with DEFAULTS; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """True if driver and executors are one process, as in tests."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local master may run without that setting; it then gets a temporary folder, one for
    the whole session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="evenkeel-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut, and
    still there when executors are lost."""
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, by Hadoop's own classes, so that any store works."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    store, place = _folder(spark, path)
    if not store.exists(place):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that a run left in the shared folder; results that are still read from it are lost."""
    store, place = _folder(spark, path)
    store.delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; Spark itself distributes the file."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='evenkeel-code-')}/{top.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
