"""The log of writes as a stream: each micro-batch goes to the merged store and to the stores of its sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.mutations import asked_ids, owners, route, write_tools
from quernel.session import materialise, passing

LOG = "seq bigint, tool string, args string"
OWNERS = "id string, seq bigint, owner string"
#: Parts that the sessions' stores of a batch lie in.
PARTS = 16


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON lines of LOG under `source`; writes Parquet to target/merged, target/sessions/part=..., target/owners.

    A batch is written under its own number, so a batch that is run again after a failure replaces itself. Writes are
    routed as of their place in the log: owners known from earlier batches stand before the batch's own writes, so
    batches give what one replay of the whole log gives, if they come in order of seq. Of the owners, only the nodes that a
    batch names are looked up; their tables are merged as their numbers add up, so a batch reads at most one table for each
    binary digit of its number. Sessions lie in PARTS parts by the hash of their file, each with a file a task, not one a session.
    """

    def batch(df: DataFrame, number: int) -> None:
        with passing(spark):
            route_batch(df, number)

    def route_batch(df: DataFrame, number: int) -> None:
        log = materialise(write_tools(df).select("seq", "tool", "args"), "batch")
        named = asked_ids(log).distinct()
        known = owners_before(spark, target, number).join(named, "id", "left_semi")
        known = known.groupBy("id").agg(F.max(F.struct("seq", "owner")).alias("o")).select("id", "o.seq", "o.owner")
        earlier = known.select("seq", F.lit("add_entity").alias("tool"), F.to_json(F.struct("id", F.struct(F.col("owner").alias("conversation")).alias("metadata"))).alias("args"))
        routed = route(earlier.unionByName(log)).select("seq", "session", "file")
        placed = log.join(routed, "seq").where("session is not null").withColumn("part", F.pmod(F.hash("file"), F.lit(PARTS)))
        log.write.mode("overwrite").parquet(f"{target}/merged/batch={number}")
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/sessions/batch={number}")
        _add_owners(spark, target, number, owners(log))

    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spans(number: int) -> list[tuple[int, int]]:
    """The ranges of batches before `number` whose owners lie in one table each: one for each binary digit of the number."""
    out, start = [], 0
    for bit in reversed(range(number.bit_length())):
        if number >> bit & 1:
            out.append((start, start + (1 << bit)))
            start += 1 << bit
    return out


def owners_before(spark: SparkSession, target: str, number: int) -> DataFrame:
    """id, seq, owner of the batches before, the last of each id in each table."""
    paths = [f"{target}/owners/{a}-{b}" for a, b in spans(number)]
    return spark.read.schema(OWNERS).parquet(*paths) if paths else spark.createDataFrame([], OWNERS)


def _add_owners(spark: SparkSession, target: str, number: int, new: DataFrame) -> None:
    """The table that ends with this batch: its own owners and those of the tables that it completes. Every table is merged
    once for each doubling, so all merges together are the batches times the logarithm of their number."""
    start = spans(number + 1)[-1][0]
    held = [f"{target}/owners/{a}-{b}" for a, b in spans(number) if a >= start]
    both = new.select("id", "seq", "owner")
    both = both.unionByName(spark.read.schema(OWNERS).parquet(*held)) if held else both
    both.groupBy("id").agg(F.max(F.struct("seq", "owner")).alias("o")).select("id", "o.seq", "o.owner").write.mode("overwrite").parquet(f"{target}/owners/{start}-{number + 1}")
