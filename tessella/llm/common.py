"""What the operators of this subpackage share: tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows, at this width, stay under this bound.
BROADCAST_BYTES = 48 << 20

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None


#: Tables that this process wrote and did not remove.
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the tables that were written within: results have to be read or stored by then."""
    kept = len(_TABLES)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _TABLES[kept:]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        del _TABLES[kept:]


def release() -> None:
    """Gives freed memory of a Python worker back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def fits(table: DataFrame, row_bytes: int) -> bool:
    """Whether a (written) table may be broadcast: its whole size is known and bounded."""
    return table.count() * row_bytes <= BROADCAST_BYTES


def checked_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join that broadcasts right if its checked size is small and else shuffles both sides."""
    return left.join(F.broadcast(right) if fits(right, row_bytes) else right, on, how)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def local_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
