"""Session helpers: the shared folder, cut lineage, checked broadcasts, skew-proof lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a dimension table is broadcast; beyond either the planner's shuffled joins are used.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Where that is unset, a session on one machine
    gets a temporary folder of its own and the setting; on a cluster it is an error, as no other folder is known to be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="quernel-")
            atexit.register(_remove_local, path)
    return path.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for made in _MADE:
        made.append(path)
    return path


_MADE: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are made inside when it is left, for work that goes on and on, such as micro-batches."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the cluster's own clean-up has the folder
        pass


#: Bytes of code up to which the JVM compiles a method; beyond, it runs it step by step.
COMPILED = "8000"


def materialise(df: DataFrame, name: str, large_code: bool = False) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors, as the files lie in the shared folder.
    `large_code`: the expressions are so many that one method for the whole stage wouldn't be compiled; they are split then."""
    spark = df.sparkSession
    path = scratch(spark, name)
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    if large_code:
        spark.conf.set(limit, COMPILED)
    try:
        df.write.parquet(path)
    finally:
        if large_code:
            spark.conf.set(limit, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Removes a table that `materialise` gave and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES, written: bool = False) -> DataFrame:
    """Hint a broadcast only when the table is found to be small, in rows and in bytes; otherwise leave the join to the
    planner. The table is written first, so that nothing behind it runs a second time, unless it is one that `materialise`
    gave (`written`); its bytes are those of the values as text, a bound on what the few rows take."""
    df = df if written else materialise(df, "dimension")
    held = F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(8)) for c in df.columns), F.lit(0)).cast("bigint"))
    n, size = df.limit(rows + 1).agg(F.count("*"), held).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df


def lookup(left: DataFrame, right: DataFrame, key: str, copies: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of `left` with `right`, unique in `key`, where `copies` of `right` counts the rows of `left` with the key.

    Keys with more than total/parts rows are at most `parts`, so they are broadcast, whatever share of `left` they hold;
    all others are joined by a shuffle in which no key has more than total/parts rows.
    """
    hot = F.col(copies) > max(1, total // parts)
    heavy = F.broadcast(right.where(hot))
    return left.join(heavy, key).unionByName(left.join(right.where(~hot), key))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
