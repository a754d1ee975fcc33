"""Helpers shared by the training-data operators: shared storage, text units, bounded joins."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, `[\x20\x09-\x0D]`; bytes.split() splits on exactly these.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of a join may be broadcast; larger sides are shuffled (see join_small).
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths written inside each open block of cleaned().
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, in the end, what was written inside the block, apart from paths that the caller takes out of the list."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and a lost executor costs a reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, part_bytes: int = 128 << 20) -> int:
    """Partitions of at most about part_bytes each by the optimizer's estimate, and at least as many as the session's setting."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an unknown size is estimated beyond all measure
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // part_bytes), 1 << 20) if size < 1 << 60 else 0)


def released(work):
    """work(batches), after which the task's Python worker gives what it has freed back to the machine.

    Workers live on between tasks; without this they would hold what their largest task took.
    """

    @wraps(work)
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return run


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, pruned to the columns named."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plainly_named(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on, for functions over Arrow batches, which take no dots in names."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def join_small(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner", salts: int = 16, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a settled side with one row per key to df, whose keys may be skewed and null-free.

    A side of at most `rows` rows is broadcast; a larger one is copied to `salts` salts, so that a hot key of df spreads, and joined by
    sorting: its size as a file, which the optimizer goes by, says nothing of its copies.
    """
    if side.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(side), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", salt).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
