"""Session settings that every query here assumes, and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries assume; on a cluster the submitted session is used instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if is_local(master) and "spark__checkpoint__dir" not in conf:
        conf["spark__checkpoint__dir"] = tempfile.mkdtemp(prefix="quillspark-")  # one machine: its temporary folder is shared
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; only a local session without one gets a folder beside its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; a local-cluster is not."""
    return master == "local" or master.startswith("local[")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: what a loop builds on must not grow with its rounds.

    It is Parquet, so readers prune columns and know its size. The table goes with discard(), once nothing reads it.
    """
    path = f"{shared_folder(df.sparkSession)}/quillspark-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by settled() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quillspark_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes its columns from what the caller selects."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
