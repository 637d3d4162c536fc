"""A session with the settings that the plans assume, and the folder for intermediate tables."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ledgerine", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution and UTC; sizes of partitions are left to the runtime."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
    for k, v in (own | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    out = tempfile.mkdtemp(prefix="ledgerine-scratch-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A temporary one, deleted at exit, only where the setting is absent and all tasks run on the driver's machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def scratch_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/ledgerine-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read again: what several readers want is made once, and a lost executor costs a reread."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
