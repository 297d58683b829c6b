"""Duplicates hidden by spelling: a ledger of canonical keys with counts, kept up batch by batch.

The ledger lies under a path in buckets of the key's hash, and stays there from one call to the next. A batch is aggregated
to (key, copies, first) before anything is shuffled, full-outer-joined with the buckets it touches, and the sums go to a new
version of those buckets; other buckets stay as they are. A version counts once its list is written, and the buckets it
replaces go then. The earliest record of a key represents it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.session import lookup, materialise, scratch

BATCHES = 4
#: Keys that a new ledger plans for a bucket, and keys that one file of a bucket has about.
BUCKET_KEYS, FILE_KEYS, LEAST_BUCKETS = 4_000_000, 500_000, 4


def bare(text: Column) -> Column:
    """Letters and digits in order, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def canonical_json(text: Column) -> Column:
    """The same for the same JSON value whatever the order of fields and the white space; other text is itself."""
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(text.isNull(), "n").otherwise(F.coalesce(F.when(whole, F.concat(F.lit("j"), F.to_json(F.try_parse_json(text)))), F.concat(F.lit("t"), text)))


def canonical_key(spelled: list[str], json_columns: list[str]) -> Column:
    """256 bits of the record's canonical form; lengths keep neighbouring parts apart."""
    parts = [*(bare(F.col(c)) for c in spelled), *(canonical_json(F.col(c)) for c in json_columns)]
    return F.unhex(F.sha2(F.concat_ws(":", *(x for p in parts for x in (F.length(p).cast("string"), p))), 256))


class CopyLedger:
    """key, copies, first (smallest position) for all batches so far.

    A ledger opened on a path that has one goes on with it, with the buckets it was made with; several files a bucket, more as
    it grows, so the tasks that write it aren't bounded by the buckets. What `read` gave is gone after the next `add`.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS):
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets, self.version, self.rows = buckets, 0, 0
        self.at: dict[int, int] = {}  # bucket -> version that has it
        self.batches: list[str] = []
        lists = self._path(f"{self.path}/_lists")
        if self._files.exists(lists):
            done = [int(f.getPath().getName().removesuffix(".json")) for f in self._files.listStatus(lists) if f.getPath().getName().endswith(".json")]
            if done:
                held = json.loads(spark.read.text(f"{self.path}/_lists/{max(done)}.json").first()[0])
                self.buckets, self.version, self.rows, self.batches = held["buckets"], held["version"], held["rows"], held["batches"]
                self.at = {int(b): v for b, v in held["at"].items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        held = {b: v for b, v in self.at.items() if buckets is None or b in buckets}
        schema = "key binary, copies bigint, first bigint, bucket int"
        if not held:
            return self.spark.createDataFrame([], schema)
        out = None
        for v in sorted(set(held.values())):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/v={v}").where(F.col("bucket").isin(*(b for b in held if held[b] == v)))
            out = part if out is None else out.unionByName(part)
        return out

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """`batch` has key, pos. Adding no rows changes nothing. A batch with a name counts once, however often it is added,
        so a run that broke off can be started again; one without a name counts each time."""
        if name is not None and name in self.batches:
            return
        bucket = F.pmod(F.hash("key"), F.lit(self.buckets)).alias("bucket")
        new = materialise(batch.groupBy("key").agg(F.count("*").alias("copies"), F.min("pos").alias("first")).select("*", bucket), "batch")
        sizes = {r.bucket: r.n for r in new.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        touched = sorted(sizes)
        if touched:
            # partitions are a multiple of the buckets, and of the same hash: each has keys of one bucket, and is one file
            parts = self.buckets * max(1, -(-(self.rows + sum(sizes.values())) // (self.buckets * FILE_KEYS)))
            n, o = new.repartition(parts, "key").alias("n"), self.read(touched).repartition(parts, "key").alias("o")
            merged = n.join(o, F.col("n.key") == F.col("o.key"), "full_outer").select(
                F.coalesce("n.key", "o.key").alias("key"), (F.coalesce("n.copies", F.lit(0)) + F.coalesce("o.copies", F.lit(0))).alias("copies"),
                F.least("n.first", "o.first").alias("first"), F.coalesce("n.bucket", "o.bucket").alias("bucket"),
            )
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={self.version + 1}")
        self._commit(touched, name, sum(sizes.values()))

    def _commit(self, touched: list[int], name: str | None, rows: int) -> None:
        gone = [(b, self.at[b]) for b in touched if b in self.at]
        self.version += bool(touched)
        self.rows += rows
        self.at |= dict.fromkeys(touched, self.version)
        self.batches += [name] if name is not None else []
        held = {"buckets": self.buckets, "version": self.version, "rows": self.rows, "batches": self.batches, "at": self.at}
        number = len(self.batches) + self.version
        out = self._files.create(self._path(f"{self.path}/_lists/{number}.tmp"), True)
        data = json.dumps(held).encode()
        out.write(data, 0, len(data))
        out.close()
        self._files.rename(self._path(f"{self.path}/_lists/{number}.tmp"), self._path(f"{self.path}/_lists/{number}.json"))
        for b, v in gone:
            self._files.delete(self._path(f"{self.path}/v={v}/bucket={b}"), True)


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    return materialise(nodes.select("pos", canonical_key(["id", "label"], ["properties"]).alias("key")), "keyed")


def collapse(keyed: DataFrame, batches: int = BATCHES, path: str | None = None, buckets: int | None = None) -> CopyLedger:
    """A ledger of all rows of (pos, key), in batches by arrival: equal ranges of `pos`; rows without `pos` can't be copies.
    With a path the ledger there is kept up: ranges it has already aren't added again."""
    low, high, rows = keyed.agg(F.min("pos"), F.max("pos"), F.count("pos")).first()
    ledger = CopyLedger(keyed.sparkSession, path, buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_KEYS)))
    if low is None:
        return ledger
    step = -(-(high - low + 1) // batches)
    for start in range(low, high + 1, step):
        end = min(start + step - 1, high)
        ledger.add(keyed.where(F.col("pos").between(start, end)), f"{start}-{end}")
    return ledger


def copies(keyed: DataFrame, ledger: CopyLedger) -> DataFrame:
    """first_pos, pos of every row but the first of its group, however large the group."""
    total = keyed.count()
    groups = ledger.read().where("copies > 1").select("key", "copies", F.col("first").alias("first_pos"))
    return lookup(keyed, groups, "key", "copies", total).where("pos > first_pos").select("first_pos", "pos")


def representatives(nodes: DataFrame, keyed: DataFrame, ledger: CopyLedger) -> DataFrame:
    """The first row of every group as it is, with `copies`."""
    firsts = ledger.read().select(F.col("first").alias("pos"), F.col("copies").alias("copies_held"))
    return nodes.drop("copies_held").join(firsts, "pos")
