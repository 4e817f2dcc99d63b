"""Small helpers every operator shares: sessions, table reads, key forms, staging."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n "
NANOS_PER_DAY = 86_400_000_000_000


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: list[str] = []  # what this process wrote below the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a folder of its own, gone at exit."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        have = option.get() if option.isDefined() else None
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="fedlens-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        have = f"file://{own}"
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete all that this process staged; results that were not yet read are lost. Returns how many tables that were."""
    gone, _STAGED[:] = list(_STAGED), []
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)


@atexit.register
def _clean_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        spark = SparkSession.getActiveSession()
        if spark is not None and _STAGED:
            clean(spark)


def plain(key: Column) -> Column:
    """Lower case without blanks around; blank becomes null."""
    return F.nullif(F.lower(F.btrim(key, F.lit(BLANKS))), F.lit(""))


def asset_form(key: Column) -> Column:
    """`plain` without slashes at the end."""
    return F.nullif(F.btrim(F.rtrim(plain(key), F.lit("/")), F.lit(BLANKS)), F.lit(""))


def sender_form(key: Column) -> Column:
    """`plain` without a leading 0x."""
    bare = F.lower(F.btrim(key, F.lit(BLANKS)))
    return F.nullif(F.when(bare.startswith("0x"), F.substring(bare, 3, 2**31 - 1)).otherwise(bare), F.lit(""))


def whole_seconds(ts: Column) -> Column:
    """Unix seconds; from 10^11 on a value is taken as milliseconds, which are cut off."""
    ts = ts.cast("long")
    return F.when(ts >= 100_000_000_000, F.expr("1L") * F.floor(ts / 1000)).otherwise(ts)


def to_nanos(instant: Column) -> Column:
    """Unix nanoseconds from nano-, micro-, milliseconds or seconds, told apart by magnitude."""
    t = instant.cast("long")
    size = F.abs(t)
    return (
        F.when(size >= 100_000_000_000_000_000, t)
        .when(size >= 100_000_000_000_000, t * 1000)
        .when(size >= 100_000_000_000, t * 1_000_000)
        .otherwise(t * 1_000_000_000)
    )
