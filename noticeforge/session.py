"""Sessions, and where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the library needs of a session, wherever it runs.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what is settled is removed once nothing refers to it
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(name: str = "noticeforge", cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    more = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    }
    for key, value in (CONF | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir. Only a session whose
    master is local may leave it unset, as tests do; it gets a temporary folder. Anywhere else that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="noticeforge-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named or current.get()


def settle(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and goes on from there: a lost executor loses nothing,
    and what reads the result twice computes it once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """The same as a table: columns are packed, and what isn't used isn't read. For wide rows that are read again; the
    table stays in the shared folder until the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended
        pass


def skewless(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
