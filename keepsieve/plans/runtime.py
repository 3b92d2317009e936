"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for local sessions without one.
_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or its checkpoint folder.

    Only where a local session names none (tests, a laptop) one local folder is
    made for it, which is removed with the process; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="keepsieve-shared-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return _LOCAL[sc.applicationId]


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` into the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def local_session(name: str = "keepsieve", cpus: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KEEPSIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables written by ``keep_table`` and not yet deleted.
_KEPT: list[tuple[SparkSession, str]] = []


def keep_table(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table into the shared folder and reads it back.

    Used where a result feeds several joins: it survives lost executors and is
    stored compressed and column-wise, unlike a checkpoint. ``drop_kept`` deletes
    these tables once results are stored.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/keepsieve-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _KEPT.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> int:
    """Deletes the tables that ``keep_table`` wrote for this session; returns their number. Results built on them must be stored before."""
    mine = [path for session, path in _KEPT if session is spark]
    _KEPT[:] = [(session, path) for session, path in _KEPT if session is not spark]
    for path in mine:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(mine)


#: Inputs of at most so many estimated bytes are dealt evenly over the cores.
SMALL = 16 << 20


def planned_bytes(df: DataFrame) -> int:
    """Size of the whole files a plan reads, as the plan knows it, so nothing runs to find it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def parts_of(df: DataFrame, each: int, least: int = 8) -> int:
    """Number of parts of ``each`` bytes for the rows of ``df``, by the size of its files; rows of unknown size are counted as 100 bytes each."""
    size = planned_bytes(df)
    return max(least, (size if size < 1 << 60 else 100 * df.count()) // each)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores if it is small: a single small file has one row group, hence one task.

    A larger input has splits enough, and nothing is moved.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if planned_bytes(df) <= SMALL else df
