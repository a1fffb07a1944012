"""Sessions, table access and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("tonegrid").config(map=settings).getOrCreate()
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a folder or a single file.

    Spark 4.1 takes a union of two shuffles by the same keys as shuffled by those keys, also where adaptive execution has since coalesced the two
    differently; a window over it then sees parts of its groups. Wrong results were measured, so that shortcut is turned off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once an application, so that they needn't find it on their own paths."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tonegrid-")  # Spark copies the archive from the driver to the executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/tonegrid.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/tonegrid.zip")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the one given to SparkContext.setCheckpointDir. Only a local session, whose
    executors are this machine, gets a temporary folder where neither is set; any other master raises, since a folder of one machine would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tonegrid-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: executors may be lost afterwards without recomputing. The table is
    deleted by discard(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tonegrid-{uuid.uuid4().hex}"
    folder, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    df.write.option("compression", "zstd").parquet(path)
    folder.getFileSystem(conf).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm, roots = spark.sparkContext._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if root.rsplit("/", 1)[1].startswith("tonegrid-"):
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
