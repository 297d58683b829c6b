"""Queries of the operators for training data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import copies, mixing, packing, pairs, reading, survivors, tokens
from quernel.session import materialise, read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = pairs.frequent_pairs(pairs.decision_baskets(read(spark, sf_dir, "kg_decisions")))
    conversation = pairs.frequent_pairs(pairs.conversation_baskets(read(spark, sf_dir, "kg_nodes")))
    kinds = (("decision", decision), ("conversation", conversation))
    found = [df.select(F.lit(kind).alias("basket"), "id_a", "id_b") for kind, df in kinds]
    return found[0].unionByName(found[1])


def _measured(found: DataFrame) -> DataFrame:
    return found.select("id_a", "id_b", "together", "count_a", "count_b", "baskets", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p1_decision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(pairs.frequent_pairs(pairs.decision_baskets(read(spark, sf_dir, "kg_decisions"))))


def p1_conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(pairs.frequent_pairs(pairs.conversation_baskets(read(spark, sf_dir, "kg_nodes"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = copies.keyed_nodes(read(spark, sf_dir, "kg_nodes"))
    return copies.copies(keyed, copies.collapse(keyed))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "kg_nodes")
    keyed = copies.keyed_nodes(nodes)
    return copies.representatives(nodes, keyed, copies.collapse(keyed)).select("pos", "id", "label", "copies_held")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.with_trust(read(spark, sf_dir, "kg_nodes"), read(spark, sf_dir, "kg_writers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No field depends on another here, so the search ends at its root in every group."""
    rows = survivors.counted_metadata(_rows(spark, sf_dir))
    return survivors.winners(survivors.best_bundles(rows, survivors.node_bundles()), ["type", "label", "metadata"])


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors whose type and label must stand side by side in some row of the id."""
    best = survivors.best_bundles(_rows(spark, sf_dir), survivors.consistent_bundles(), (("type", "label"),))
    return best.where("rows >= 2").select("id", F.col("type").alias("type_pos"), F.col("label").alias("label_pos"))


def p5_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of bundles of several fields: name, place and extraction, the last two as they stood beside the name."""
    best = survivors.best_bundles(survivors.with_parts(_rows(spark, sf_dir)), *survivors.dependent_bundles())
    return best.where("rows >= 2").select("id", *(F.col(b).alias(f"{b}_pos") for b in ("name", "place", "extraction")))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, packing.Plan]]:
    sizes = tokens.token_sizes(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return packing.pack(sizes, read(spark, sf_dir, "pack_sizes"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str):
    sizes = materialise(tokens.token_sizes(read(spark, sf_dir, "documents"), ["doc_id", "source"], "text"), "sizes")
    asked, sources = mixing.plan(sizes, read(spark, sf_dir, "mix_targets"))
    return mixing.mix(sizes, sources), asked, sources


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir))


def _grades(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    model = reading.fit_passages(read(spark, sf_dir, "level_passages"))
    return reading.grades(read(spark, sf_dir, "documents").drop("lang"), model, keys)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grades(spark, sf_dir, ["doc_id"]).where("level >= 3.5").select("doc_id")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.profile(_grades(spark, sf_dir, ["doc_id", "source"]))


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by language on passages that nothing of the model has seen, with and without what it knows of words."""
    passages = reading.read_passages(read(spark, sf_dir, "level_passages"))
    held = [(k, name, *v) for name, vocabulary in (("all", True), ("no vocabulary", False)) for k, v in reading.validate(passages, vocabulary).items()]
    return spark.createDataFrame(held, "lang string, features string, parts int, mean_error double, right_side double")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_decision_pairs, p1_conversation_pairs, p4_found, p4_entities, p5_found, p5_consistent, p5_bundles,
        p7_packed, p7_fill, p8_mixture, p8_shares, p9_found, p9_profile, p9_validation,
    )
}
