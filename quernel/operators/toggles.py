"""A flag per session with a default: migration of stored formats, resolution, last write wins, a cap on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, FORMAT = 400, 1


def migrate(files: DataFrame) -> DataFrame:
    """name, default, session_id, on, updated_at of stored files (name, text).

    A file with v >= 1 keeps its default, true only for a literal true; without v the default is on and the sessions stay. The
    oldest format has the sessions at the top, of which only those that are on count. Missing or broken text: default on,
    no sessions. One row without a session where there is none.
    """
    v = F.try_parse_json("text")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    version = F.coalesce(F.try_variant_get(v, "$.v", "int"), F.lit(0))
    default = F.when(is_object & (version >= FORMAT), F.coalesce(F.try_variant_get(v, "$.default", "boolean"), F.lit(False))).otherwise(True)
    bag = F.try_variant_get(v, "$.sessions", "variant")
    has_bag = F.coalesce(F.schema_of_variant(bag).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    entries = F.from_json(F.when(is_object, F.when(has_bag, F.to_json(bag)).otherwise(F.to_json(v))), "map<string,string>")
    rows = files.select("name", default.alias("default"), has_bag.alias("has_bag"), F.explode_outer(entries).alias("session_id", "entry"))
    e = F.try_parse_json("entry")
    on = F.coalesce((F.schema_of_variant(F.try_variant_get(e, "$.on", "variant")) == "BOOLEAN") & F.try_variant_get(e, "$.on", "boolean"), F.lit(False))
    good = F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)) & (F.col("session_id") != "") & (F.col("has_bag") | on)
    kept = rows.withColumns({"on": on, "good": F.coalesce(good, F.lit(False)), "updated_at": F.coalesce(F.try_variant_get(e, "$.updatedAt", "string"), F.lit(""))})
    some = kept.where("good").select("name", "default", "session_id", "on", "updated_at")
    none = kept.groupBy("name", "default").agg(F.max("good").alias("any")).where("not any").select("name", "default", F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("boolean").alias("on"), F.lit(None).cast("string").alias("updated_at"))
    return some.unionByName(none)


def last_set(writes: DataFrame) -> DataFrame:
    """session_id, on, updated_at as last written by (updated_at, seq); only a literal true is on; '' is no session."""
    return writes.where("session_id <> ''").groupBy("session_id").agg(F.max(F.struct("updated_at", "seq", F.coalesce("on", F.lit(False)).alias("on"))).alias("w")).select("session_id", "w.on", "w.updated_at")


def resolve(asked: DataFrame, stored: DataFrame, default: bool) -> DataFrame:
    """session_id, on, explicit: the session's own flag, else the default; whether it has one."""
    own = stored.select("session_id", F.coalesce("on", F.lit(False)).alias("own"))
    return asked.select("session_id").join(own, "session_id", "left").select("session_id", F.coalesce("own", F.lit(default)).alias("on"), F.col("own").isNotNull().alias("explicit"))


def newest(rows: DataFrame, most: int = MOST, order: str = "updated_at", key: str = "session_id") -> DataFrame:
    """The `most` rows of latest `order`, ties by key: a top-k, not a sort of all rows."""
    return rows.orderBy(F.desc_nulls_last(order), F.desc(key)).limit(most)


def stored_form(rows: DataFrame, default: bool, most: int = MOST) -> DataFrame:
    """One row, `text`: the file that keeps the default and the newest `most` sessions; `migrate` reads it back."""
    entry = F.struct(F.coalesce("on", F.lit(False)).alias("on"), F.col("updated_at").cast("string").alias("updatedAt"))
    held = newest(rows.where("session_id <> ''"), most).agg(F.map_from_entries(F.collect_list(F.struct("session_id", entry.alias("e")))).alias("sessions"))
    return held.select(F.to_json(F.struct(F.lit(FORMAT).alias("v"), F.lit(default).alias("default"), "sessions")).alias("text"))
