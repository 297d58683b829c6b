"""The best surviving record of each duplicate group, built of whole bundles of fields.

A bundle is a group of fields that only make sense together and are taken from one row. Every row offers a candidate for
each bundle, ranked by the bundle's own order (trust first, as a rule). The best choice fills as many bundles as it can and
then maximises the sum of the bundles' trusts under functional-dependency constraints: a constraint (A, B) allows a value
of A only with a value of B that some row of the group holds beside it.

Branch and bound, all of it as aggregates, so that no group is ever a list in one task:

* root: each bundle's best candidate without constraints, one aggregation with partial maxima. That is the bound of the
  group, and where it satisfies the constraints, or there are none, it is the answer and nothing is branched;
* branching: a group that is left has one branch for each value of the bundle that all constraints name. A branch's bound is
  its value's trust and the others' best; the best whole row is the incumbent, and branches under it are cut off;
* a branch fixes what the constraints ask of the other bundles, each of which then has its best supported value: one more
  aggregation over the distinct combinations of values solves all branches, whatever their number and size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quernel.functions import json_tape
from quernel.session import checked_broadcast, materialise

#: Texts that stand for "not known", in lower case.
PLACEHOLDERS = ("null", "none", "n/a", "na", "n.a.", "?", "??", "???", "-", "--", "unknown", "not known", "undefined", "nil", "nan", "tbd", "unbekannt", "未知", "不详", "无")
#: What a filled bundle counts beside its trust: a choice that fills more bundles always wins.
FILLED = 1e9


@dataclass(frozen=True)
class Bundle:
    name: str
    fields: tuple[str, ...]
    usable: Column
    rank: tuple[Column, ...]  # greatest wins; pos is added last


def blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\p{Z}\x1c-\x1f]+", "") == ""


def known(text: Column) -> Column:
    """Neither blank nor a placeholder."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return ~blank(text) & ~bare.isin(*PLACEHOLDERS)


@F.arrow_udf(LongType())
def filled_fields(text: pa.Array) -> pa.Array:
    """How many top-level fields of the JSON object are not null, blank, [] or {}; 0 for what is no object. Text of an object
    within a JSON string counts as the object, however often it was put into a string."""
    return pa.array(json_tape.filled(text), pa.int64())


@F.arrow_udf(StringType())
def opened(text: pa.Array) -> pa.Array:
    """The text with its JSON strings opened, null where that is no JSON object."""
    import pyarrow.compute as pc

    out, is_object = json_tape.opened(text)
    return pc.if_else(pa.array(is_object), out, pa.scalar(None, pa.large_string())).cast(pa.string())


def with_trust(nodes: DataFrame, writers: DataFrame) -> DataFrame:
    """Adds `trust` of the row's writer, 0 where it is null or not listed; a writer listed twice has its highest."""
    listed = checked_broadcast(writers.where("writer is not null").groupBy("writer").agg(F.max("trust").alias("trust")))
    return nodes.drop("trust").join(listed, "writer", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))


def counted_metadata(nodes: DataFrame) -> DataFrame:
    """Adds `filled`, of `metadata`; worked out once, before anything is shuffled."""
    return nodes.drop("filled").withColumn("filled", filled_fields(F.col("metadata")))


def node_bundles() -> list[Bundle]:
    """For rows with trust and filled."""
    return [
        Bundle("type", ("type",), known(F.col("type")), (F.col("trust"), F.col("written_at"))),
        Bundle("label", ("label",), ~blank(F.col("label")), (F.col("written_at"),)),
        Bundle("metadata", ("metadata",), F.col("filled") > 0, (F.col("filled"), F.col("trust"), F.col("written_at"))),
    ]


def _value(b: Bundle) -> Column:
    """The bundle's value in 128 bits: no text is shuffled to compare it."""
    return F.when(b.usable, F.unhex(F.md5(F.to_json(F.struct(*b.fields), {"ignoreNullFields": "false"}))))


def _rank(b: Bundle) -> Column:
    return F.struct(*(r.alias(f"r{i}") for i, r in enumerate(b.rank)), F.col("pos"))


def best_bundles(rows: DataFrame, bundles: list[Bundle], constraints: tuple[tuple[str, str], ...] = (), group: str = "id") -> DataFrame:
    """group, rows, per bundle the pos of the row it is taken from, and branches: how many values were branched on (0: the
    root was the answer). A pos is null where no row has a usable value, or where none agrees with the others: a choice
    fills as many bundles as the constraints allow, and then has the greatest trust.

    `rows` has pos, trust and the fields. Groups of null aren't groups. Ties end at the largest pos, so the result is
    one. A null in an order ranks lowest. Without usable values in a constrained bundle, its constraints don't apply.
    All constraints name one bundle, whichever; bundles that none names are chosen at the root.
    """
    named = rows.where(F.col(group).isNotNull())
    if not constraints:
        offers = named.select(group, *(F.when(b.usable, _rank(b)).alias(b.name) for b in bundles))
        best = offers.groupBy(group).agg(F.count("*").alias("rows"), *(F.max(b.name).alias(b.name) for b in bundles))
        return best.select(group, "rows", *(F.col(b.name)["pos"].alias(b.name) for b in bundles), F.lit(0).cast("bigint").alias("branches"))
    shared = set(constraints[0]).intersection(*constraints)
    if not shared:
        raise ValueError("constraints must share one bundle: its values are what is branched on")
    leader = next(n for n in constraints[0] if n in shared)
    others = sorted({n for c in constraints for n in c} - {leader})
    order = [leader, *others]
    by_name = {b.name: b for b in bundles}
    offers = named.select(group, "trust", *(c for b in bundles for c in (F.when(b.usable, _rank(b)).alias(f"rank_{b.name}"), *([_value(b).alias(b.name)] if b.name in order else []))))
    # distinct combinations of values with the best row for each bundle: all that constraints and bounds need, and no texts
    tops = [F.max(F.when(F.col(f"rank_{b.name}").isNotNull(), F.struct(f"rank_{b.name}", "trust"))).alias(f"top_{b.name}") for b in bundles]
    combos = materialise(offers.groupBy(group, *order).agg(F.count("*").alias("rows"), *tops), "combos")
    best = lambda n, *more: F.max(F.when(F.col(f"top_{n}").isNotNull(), F.struct(F.col(f"top_{n}")[f"rank_{n}"].alias("rank"), *more))).alias(f"best_{n}")
    roots = combos.groupBy(group).agg(F.sum("rows").alias("rows"), *(best(b.name, *([F.col(b.name).alias("value")] if b.name in order else [])) for b in bundles))
    roots = materialise(roots.select(group, "rows", *(c for b in bundles for c in (F.col(f"best_{b.name}")["rank"]["pos"].alias(f"p_{b.name}"), *([F.col(f"best_{b.name}")["value"].alias(f"v_{b.name}")] if b.name in order else [])))), "roots")
    stands = lambda a, b: F.max((F.col(a) == F.col(f"v_{a}")) & (F.col(b) == F.col(f"v_{b}")))
    asked = lambda a, b: F.max(F.col(f"v_{a}").isNotNull() & F.col(f"v_{b}").isNotNull())
    fits = reduce(lambda x, y: x & y, (F.coalesce(stands(a, b), F.lit(False)) | ~asked(a, b) for a, b in constraints))
    open_groups = combos.join(roots.select(group, *(f"v_{n}" for n in order)), group).groupBy(group).agg(fits.alias("fits")).where("not fits").select(group)
    combos = materialise(combos.join(open_groups, group, "left_semi"), "open")

    def worth(n: str) -> DataFrame:
        """Of each value of the bundle: what it counts, and its row; the group's best with it, whatever stands beside it."""
        of = combos.where(F.col(n).isNotNull()).groupBy(group, n).agg(F.max(f"top_{n}").alias("top"))
        return of.select(group, n, (F.col("top")["trust"] + FILLED).cast("double").alias(f"t_{n}"), F.col("top")[f"rank_{n}"]["pos"].alias(f"p_{n}"))

    worths = {n: materialise(worth(n), "worth") for n in order}
    # bounds: the best of each bundle, whole rows as incumbents; of each branch the others' best as well
    most = reduce(
        lambda x, y: x.join(y, group, "full_outer"),
        (worths[n].groupBy(group).agg(F.max(f"t_{n}").alias(f"most_{n}"), F.max(F.struct(f"t_{n}", f"p_{n}")).alias(f"free_{n}")) for n in order),
    )
    flat = combos.select(group, *order)
    for n in order:
        flat = flat.join(worths[n], [group, n], "left")
    incumbent = flat.groupBy(group).agg(F.max(sum((F.coalesce(F.col(f"t_{n}"), F.lit(0.0)) for n in order), F.lit(0.0))).alias("incumbent"))
    bounds = materialise(most.join(incumbent, group), "bounds")
    others_most = sum((F.coalesce(F.col(f"most_{n}"), F.lit(0.0)) for n in others), F.lit(0.0))
    live = materialise(worths[leader].join(bounds.select(group, "incumbent", others_most.alias("rest")), group).where(F.col(f"t_{leader}") + F.col("rest") >= F.col("incumbent")).select(group, leader, f"t_{leader}", f"p_{leader}"), "branches")
    # each branch solved: of every other bundle the best value that stands beside the branch's, partial maxima
    solved = live
    for n in others:
        beside = combos.where(F.col(leader).isNotNull() & F.col(n).isNotNull()).select(group, leader, n).distinct().join(worths[n], [group, n])
        best_beside = beside.groupBy(group, leader).agg(F.max(F.struct(f"t_{n}", f"p_{n}")).alias(f"b_{n}"))
        solved = solved.join(best_beside, [group, leader], "left")
    total = F.col(f"t_{leader}") + sum((F.coalesce(F.col(f"b_{n}")[f"t_{n}"], F.lit(0.0)) for n in others), F.lit(0.0))
    taken = lambda n, c: F.coalesce(c[f"p_{n}"], F.lit(-1)).alias(f"p_{n}")
    leaves = solved.select(group, total.alias("total"), F.col(f"p_{leader}"), *(taken(n, F.col(f"b_{n}")) for n in others), F.lit(1).alias("branch"))
    # the branch that leaves the shared bundle empty: no constraint is left
    none = bounds.select(group, others_most.alias("total"), F.lit(-1).cast("bigint").alias(f"p_{leader}"), *(taken(n, F.col(f"free_{n}")) for n in others), F.lit(0).alias("branch"))
    chosen = leaves.unionByName(none).groupBy(group).agg(F.sum("branch").alias("branches"), F.max(F.struct("total", *(f"p_{n}" for n in order))).alias("c"))
    out = roots.join(chosen, group, "left")
    pos = lambda n: F.nullif(F.col("c")[f"p_{n}"], F.lit(-1))
    of = lambda n: F.when(F.col("c").isNotNull(), pos(n)).otherwise(F.col(f"p_{n}")) if n in order else F.col(f"p_{n}")
    return out.select(group, "rows", *(of(n).alias(n) for n in by_name), F.coalesce("branches", F.lit(0)).alias("branches"))


def winners(best: DataFrame, fields: list[str], group: str = "id") -> DataFrame:
    """One row for each group of two or more rows and field with a usable value: group, field, pos."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("pos")) for f in fields))).alias("w")
    return best.where("rows >= 2").select(group, each).select(group, "w.field", "w.pos").where("pos is not null")


def consistent_bundles() -> list[Bundle]:
    """Type and label, both by trust, for survivors whose type must have been seen with their label."""
    by_trust = (F.col("trust"), F.col("written_at"))
    return [Bundle("type", ("type",), known(F.col("type")), by_trust), Bundle("label", ("label",), ~blank(F.col("label")), by_trust)]


def with_parts(nodes: DataFrame) -> DataFrame:
    """Adds the parts of the metadata that belong together: city and note (the place), model and passes (the extraction)."""
    v = F.try_parse_json(opened(F.col("metadata")))
    part = {"city": "$.user_city", "note": "$.note", "model": "$.extraction.model"}
    with_v = nodes.drop(*part, "passes").withColumn("__v", v)
    texts = {c: F.try_variant_get("__v", p, "string") for c, p in part.items()}
    return with_v.withColumns(texts | {"passes": F.to_json(F.try_variant_get("__v", "$.extraction.passes", "variant"))}).drop("__v")


def dependent_bundles() -> tuple[list[Bundle], tuple[tuple[str, str], ...]]:
    """Bundles of several dependent fields, each taken whole from one row: who it is (type and label), where it was noted
    (city and note) and how it was extracted (model and passes). Place and extraction must have stood beside the name."""
    by_trust = (F.col("trust"), F.col("written_at"))
    place = ~blank(F.col("city")) | ~blank(F.col("note"))
    extraction = ~blank(F.col("model")) & F.col("passes").isNotNull()
    bundles = [Bundle("name", ("type", "label"), known(F.col("type")) & ~blank(F.col("label")), by_trust), Bundle("place", ("city", "note"), place, by_trust), Bundle("extraction", ("model", "passes"), extraction, by_trust)]
    return bundles, (("name", "place"), ("name", "extraction"))
