"""How well prototypes stand for their window (Q1-Q8).

Rows carry ``leaves`` and ``model_label`` (the model's prediction); prototypes come from ``prototypes``. Votes are
read off each row's two best prototypes, so no per-prototype job and no row-prototype table is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.operators.prototypes import proto_lists, ranked_tree


def _ranked(rows: DataFrame, protos: DataFrame) -> DataFrame:
    joined = rows.join(proto_lists(protos, "leaves"), "window_id")
    return joined.withColumn("_r", F.slice(ranked_tree(F.col("leaves"), F.col("protos")), 1, 2)).drop("protos")


def _all_prototypes(protos: DataFrame) -> DataFrame:
    return proto_lists(protos, "leaves").select("window_id", F.explode("protos").alias("_p")).select(
        "window_id", F.col("_p.id").alias("proto_id"), F.col("_p.label").alias("label"),
        F.col("_p.rank").alias("proto_rank"),
    )


def _agrees(best: Column, truth: Column) -> Column:
    """Does the prediction of this prototype (none when it shares no leaf) equal the model's?"""
    return F.coalesce(F.when(best["m"] < 0, best["label"] == truth), F.lit(False)).cast("long")


def fidelity(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Q1: share of rows where prototypes predict what the model predicts."""
    first = F.get("_r", F.lit(0))
    return _ranked(rows, protos).groupBy("window_id").agg(
        F.avg(_agrees(first, F.col("model_label"))).alias("fidelity")
    )


def contribution(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Q2: fidelity with minus without each prototype. Without it, its rows go to their second best."""
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    truth = F.col("model_label")
    ranked = _ranked(rows, protos)
    sizes = ranked.groupBy("window_id").agg(F.count(F.lit(1)).alias("_n"))
    change = ranked.where(first["m"] < 0).groupBy("window_id", first["id"].alias("proto_id")).agg(
        F.sum(_agrees(first, truth) - _agrees(second, truth)).alias("_d")
    )
    return (
        _all_prototypes(protos).join(sizes, "window_id").join(change, ["window_id", "proto_id"], "left")
        .select("window_id", "proto_id", "label", "proto_rank",
                (F.coalesce("_d", F.lit(0)) / F.col("_n")).alias("contribution"))
    )


def mean_contribution(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("window_id").agg(F.avg("contribution").alias("contribution"))


def votes(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Q3 and Q4: share of rows that vote for each prototype, and of those the share the model gives its class."""
    first = F.get("_r", F.lit(0))
    ranked = _ranked(rows, protos)
    sizes = ranked.groupBy("window_id").agg(F.count(F.lit(1)).alias("_n"))
    won = ranked.groupBy("window_id", first["id"].alias("proto_id")).agg(
        F.count(F.lit(1)).alias("_v"), F.sum((first["label"] == F.col("model_label")).cast("long")).alias("_c")
    )
    return (
        _all_prototypes(protos).join(sizes, "window_id").join(won, ["window_id", "proto_id"], "left")
        .select("window_id", "proto_id", "label", "proto_rank",
                (F.coalesce("_v", F.lit(0)) / F.col("_n")).alias("voting_frequency"),
                F.coalesce(F.col("_c") / F.col("_v"), F.lit(0.0)).alias("consistent_votes"))
    )


def hubness(rows: DataFrame, protos: DataFrame, truth: str = "label") -> DataFrame:
    """Q5: share of the rows of a class whose most similar prototype of that class is this one."""
    mine = rows.select("window_id", "idx", "leaves", F.col(truth).alias("_y")).join(
        proto_lists(protos, "leaves"), "window_id"
    )
    own = F.filter("protos", lambda p: p["label"] == F.col("_y"))
    best = F.get(ranked_tree(F.col("leaves"), own), F.lit(0))
    picked = mine.select("window_id", F.col("_y").alias("label"), best["id"].alias("proto_id"))
    sizes = picked.groupBy("window_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    won = picked.where("proto_id is not null").groupBy("window_id", "proto_id").agg(F.count(F.lit(1)).alias("_v"))
    return (
        _all_prototypes(protos).join(sizes, ["window_id", "label"], "left").join(won, ["window_id", "proto_id"], "left")
        .select("window_id", "proto_id", "label", "proto_rank",
                F.coalesce(F.col("_v") / F.col("_n"), F.lit(0.0)).alias("hubness"))
    )


def entropy_hubness(hubs: DataFrame) -> DataFrame:
    """Q6: base-2 entropy of the normalised hubness per class over max(log2 k, 1)."""
    totals = hubs.groupBy("window_id", "label").agg(F.sum("hubness").alias("_t"), F.count(F.lit(1)).alias("_k"))
    share = F.col("hubness") / F.col("_t")
    part = F.when(F.col("hubness") > 0, -share * F.log2(share)).otherwise(0.0)
    scale = F.greatest(F.log2(F.col("_k") + 1e-6), F.lit(1 + 1e-6))
    return hubs.join(totals, ["window_id", "label"]).groupBy("window_id", "label").agg(
        F.when(F.max("_t") > 0, F.sum(part) / F.max(scale)).otherwise(0.0).alias("entropy_hubness")
    )


def mean_entropy_hubness(entropies: DataFrame) -> DataFrame:
    return entropies.groupBy("window_id").agg(F.avg("entropy_hubness").alias("entropy_hubness"))


def distribution_similarity(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Q7 and Q8: mean similarity of each prototype to the rows of its class and to those of other classes.

    The mean over rows of the share of equal leaves is the mean over trees of the share of rows in the prototype's
    leaf, so leaf counts replace row-prototype pairs.
    """
    leaf = F.posexplode("leaves").alias("tree", "leaf")
    counts = rows.select("window_id", "label", leaf).groupBy("window_id", "tree", "leaf", "label").agg(
        F.count(F.lit(1)).alias("_n")
    )
    sizes = rows.groupBy("window_id", "label").agg(F.count(F.lit(1)).alias("_rows"))
    totals = sizes.groupBy("window_id").agg(F.sum("_rows").alias("_all"))
    ids = _all_prototypes(protos)
    cells = protos.select("window_id", F.col("label").alias("_y"), "proto_rank", leaf, F.size("leaves").alias("_t"))
    hits = cells.join(counts, ["window_id", "tree", "leaf"]).groupBy("window_id", "_y", "proto_rank").agg(
        F.sum(F.when(F.col("label") == F.col("_y"), F.col("_n") / F.col("_t")).otherwise(0.0)).alias("_in"),
        F.sum(F.when(F.col("label") != F.col("_y"), F.col("_n") / F.col("_t")).otherwise(0.0)).alias("_out"),
    ).withColumnRenamed("_y", "label")
    return (
        ids.join(sizes, ["window_id", "label"], "left").join(totals, "window_id")
        .join(hits, ["window_id", "label", "proto_rank"], "left")
        .select(
            "window_id", "proto_id", "label", "proto_rank",
            (F.coalesce("_in", F.lit(0.0)) / F.col("_rows")).alias("in_distribution"),
            F.when(F.col("_all") > F.coalesce("_rows", F.lit(0)),
                   F.coalesce("_out", F.lit(0.0)) / (F.col("_all") - F.coalesce("_rows", F.lit(0)))
                   ).alias("out_distribution"),
        )
    )
