"""P1-P15 and Q1-Q8 on the given embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise.operators import prototypes, quality
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import (
    TREES, VECTOR_SIZE, first_prototypes, l2_sql, shared_sql, tree_windows_sql, vector_windows, with_cell_leaves
)

BASE = tree_windows_sql()


def _rows(spark, sf):
    return with_cell_leaves(vector_windows(spark, sf))


def _protos(spark, sf):
    return first_prototypes(_rows(spark, sf))


@query("forest_leaves")
def _forest(spark, sf):
    rows = vector_windows(spark, sf)
    return prototypes.forest_leaves(rows).select("window_id", "idx", "label", "model_label", "leaves")


@query("tree_similarity", f"""WITH {BASE}
SELECT a.window_id, a.label, a.idx, b.idx AS other, {rnd(shared_sql('a.leaves', 'b.leaves') + f' / {TREES}.0', 'similarity')}
FROM tw a JOIN tw b ON a.window_id = b.window_id AND a.label = b.label""")
def _similarity(spark, sf):
    m = prototypes.tree_similarity(_rows(spark, sf))
    pairs = F.explode(F.arrays_zip("others", "similarity"))
    return rounded(m.select("window_id", "label", "idx", pairs.alias("p")).select(
        "window_id", "label", "idx", F.col("p.others").alias("other"), F.col("p.similarity").alias("similarity")))


@query("tree_distance", f"""WITH {BASE}
SELECT a.window_id, a.label, a.idx, {rnd('avg(1 - ' + shared_sql('a.leaves', 'b.leaves') + f' / {TREES}.0)', 'mean_distance')}
FROM tw a JOIN tw b ON a.window_id = b.window_id AND a.label = b.label GROUP BY 1, 2, 3""")
def _distance(spark, sf):
    d = prototypes.tree_distance(prototypes.tree_similarity(_rows(spark, sf)))
    mean = F.aggregate("distance", F.lit(0.0), lambda s, x: s + x) / F.size("distance")
    return rounded(d.select("window_id", "label", "idx", mean.alias("mean_distance")))


def _select(name: str, select):
    @query(name)
    def _run(spark, sf):
        return select(_rows(spark, sf)).select("window_id", "label", "proto_rank", "idx")


_select("greedy_kmedoids", prototypes.greedy_kmedoids)
_select("greedy_global", lambda rows: prototypes.greedy_global(rows, 12))
_select("greedy_weighted", lambda rows: prototypes.greedy_weighted(rows, 12))
_select("greedy_supervised", lambda rows: prototypes.greedy_supervised(rows, 12))
_select("apete", prototypes.apete)
_select("prototypes_per_window", prototypes.prototypes_per_window)


@query("kmeans_prototypes")
def _kmeans(spark, sf):
    return prototypes.kmeans_prototypes(vector_windows(spark, sf), VECTOR_SIZE).select("label", "proto_rank", "idx")


TREE_RANK = f"""{BASE},
rk AS (SELECT t.window_id, t.idx, t.label AS y, t.model_label, p.proto_id, p.label, p.proto_rank,
              {shared_sql('t.leaves', 'p.leaves')} AS m FROM tw t JOIN pr p ON t.window_id = p.window_id),
bs AS (SELECT *, row_number() OVER (PARTITION BY window_id, idx ORDER BY m DESC, proto_id) AS r FROM rk)"""


@query("assign_tree_prototype", f"""WITH {TREE_RANK}
SELECT window_id, idx, y AS label, CASE WHEN m > 0 THEN label END AS predicted,
       CAST(CASE WHEN m > 0 THEN proto_id ELSE -1 END AS INTEGER) AS proto_id FROM bs WHERE r = 1""")
def _assign_tree(spark, sf):
    return prototypes.assign_tree_prototype(_rows(spark, sf), _protos(spark, sf)).select(
        "window_id", "idx", "label", "predicted", "proto_id"
    )


@query("predict_by_tree_prototype", f"""WITH {TREE_RANK}
SELECT window_id, CASE WHEN m > 0 THEN label END AS predicted, count(*) AS n FROM bs WHERE r = 1 GROUP BY 1, 2""")
def _predict_tree(spark, sf):
    return prototypes.assign_tree_prototype(_rows(spark, sf), _protos(spark, sf)).groupBy(
        "window_id", "predicted"
    ).agg(F.count("*").alias("n"))


L2_RANK = f"""{BASE},
ds AS (SELECT t.window_id, t.idx, t.label AS y, p.proto_id, p.label, p.proto_rank, {l2_sql('t.features', 'p.features')} AS d
       FROM tw t JOIN pr p ON t.window_id = p.window_id),
bl AS (SELECT *, row_number() OVER (PARTITION BY window_id, idx ORDER BY d, proto_id) AS r FROM ds)"""


@query("assign_l2_prototype", f"""WITH {L2_RANK}
SELECT window_id, idx, y AS label, label AS predicted, CAST(proto_id AS INTEGER) AS proto_id, {rnd('d', 'distance')}
FROM bl WHERE r = 1""")
def _assign_l2(spark, sf):
    return rounded(prototypes.assign_l2_prototype(_rows(spark, sf), _protos(spark, sf)).select(
        "window_id", "idx", "label", "predicted", "proto_id", "distance"))


@query("predict_by_l2_prototype", f"""WITH {L2_RANK}
SELECT window_id, label AS predicted, count(*) AS n FROM bl WHERE r = 1 GROUP BY 1, 2""")
def _predict_l2(spark, sf):
    return prototypes.assign_l2_prototype(_rows(spark, sf), _protos(spark, sf)).groupBy(
        "window_id", "predicted"
    ).agg(F.count("*").alias("n"))


@query("prototype_score", f"""WITH {L2_RANK}
SELECT window_id, count(*) AS rows, {rnd('avg(CASE WHEN label = y THEN 1.0 ELSE 0.0 END)', 'score')}
FROM bl WHERE r = 1 GROUP BY 1""")
def _score(spark, sf):
    return rounded(prototypes.prototype_score(prototypes.assign_l2_prototype(_rows(spark, sf), _protos(spark, sf))))


@query("fidelity", f"""WITH {TREE_RANK}
SELECT window_id, {rnd('avg(CASE WHEN m > 0 AND label = model_label THEN 1.0 ELSE 0.0 END)', 'fidelity')}
FROM bs WHERE r = 1 GROUP BY 1""")
def _fidelity(spark, sf):
    return rounded(quality.fidelity(_rows(spark, sf), _protos(spark, sf)))


CONTRIBUTION = f"""{TREE_RANK},
fu AS (SELECT window_id, avg(CASE WHEN m > 0 AND label = model_label THEN 1.0 ELSE 0.0 END) AS f
       FROM bs WHERE r = 1 GROUP BY 1),
le AS (SELECT o.window_id, o.proto_id AS out_id, rk.idx, rk.m, rk.label, rk.model_label,
              row_number() OVER (PARTITION BY o.window_id, o.proto_id, rk.idx ORDER BY rk.m DESC, rk.proto_id) AS r
       FROM pr o JOIN rk ON rk.window_id = o.window_id AND rk.proto_id <> o.proto_id),
wo AS (SELECT window_id, out_id, avg(CASE WHEN m > 0 AND label = model_label THEN 1.0 ELSE 0.0 END) AS f
       FROM le WHERE r = 1 GROUP BY 1, 2),
ct AS (SELECT pr.window_id, pr.proto_id, pr.label, pr.proto_rank, fu.f - wo.f AS contribution
       FROM pr JOIN fu USING (window_id) JOIN wo ON wo.window_id = pr.window_id AND wo.out_id = pr.proto_id)"""


@query("contribution", f"""WITH {CONTRIBUTION}
SELECT window_id, CAST(proto_id AS INTEGER) AS proto_id, label, CAST(proto_rank AS INTEGER) AS proto_rank,
       {rnd('contribution', 'contribution')} FROM ct""")
def _contribution(spark, sf):
    return rounded(quality.contribution(_rows(spark, sf), _protos(spark, sf)))


@query("mean_contribution", f"""WITH {CONTRIBUTION}
SELECT window_id, {rnd('avg(contribution)', 'contribution')} FROM ct GROUP BY 1""")
def _mean_contribution(spark, sf):
    return rounded(quality.mean_contribution(quality.contribution(_rows(spark, sf), _protos(spark, sf))))


VOTES = f"""{TREE_RANK},
wn AS (SELECT window_id, proto_id, count(*) AS v, sum(CASE WHEN label = model_label THEN 1 ELSE 0 END) AS c
       FROM bs WHERE r = 1 GROUP BY 1, 2),
sz AS (SELECT window_id, count(*) AS n FROM tw GROUP BY 1)"""


@query("voting_frequency", f"""WITH {VOTES}
SELECT pr.window_id, CAST(pr.proto_id AS INTEGER) AS proto_id, {rnd('coalesce(v, 0) * 1.0 / n', 'voting_frequency')}
FROM pr JOIN sz USING (window_id) LEFT JOIN wn ON wn.window_id = pr.window_id AND wn.proto_id = pr.proto_id""")
def _votes(spark, sf):
    return rounded(quality.votes(_rows(spark, sf), _protos(spark, sf)).select("window_id", "proto_id", "voting_frequency"))


@query("consistent_votes", f"""WITH {VOTES}
SELECT pr.window_id, CAST(pr.proto_id AS INTEGER) AS proto_id, {rnd('coalesce(c * 1.0 / v, 0)', 'consistent_votes')}
FROM pr LEFT JOIN wn ON wn.window_id = pr.window_id AND wn.proto_id = pr.proto_id""")
def _consistent(spark, sf):
    return rounded(quality.votes(_rows(spark, sf), _protos(spark, sf)).select("window_id", "proto_id", "consistent_votes"))


HUBS = f"""{TREE_RANK},
ow AS (SELECT *, row_number() OVER (PARTITION BY window_id, idx ORDER BY m DESC, proto_id) AS q FROM rk WHERE label = y),
hw AS (SELECT window_id, proto_id, count(*) AS v FROM ow WHERE q = 1 GROUP BY 1, 2),
hz AS (SELECT window_id, label, count(*) AS n FROM tw GROUP BY 1, 2),
hb AS (SELECT pr.window_id, pr.proto_id, pr.label, coalesce(v, 0) * 1.0 / n AS hubness
       FROM pr JOIN hz ON hz.window_id = pr.window_id AND hz.label = pr.label
       LEFT JOIN hw ON hw.window_id = pr.window_id AND hw.proto_id = pr.proto_id),
ht AS (SELECT window_id, label, sum(hubness) AS t, count(*) AS k FROM hb GROUP BY 1, 2),
he AS (SELECT hb.window_id, hb.label,
              CASE WHEN max(t) > 0 THEN sum(CASE WHEN hubness > 0 THEN -hubness / t * log2(hubness / t) ELSE 0 END)
                   / greatest(log2(max(k) + 1e-6), 1 + 1e-6) ELSE 0 END AS e
       FROM hb JOIN ht ON ht.window_id = hb.window_id AND ht.label = hb.label GROUP BY 1, 2)"""


@query("hubness", f"""WITH {HUBS}
SELECT window_id, CAST(proto_id AS INTEGER) AS proto_id, label, {rnd('hubness', 'hubness')} FROM hb""")
def _hubness(spark, sf):
    return rounded(quality.hubness(_rows(spark, sf), _protos(spark, sf)).drop("proto_rank"))


@query("entropy_hubness", f"WITH {HUBS} SELECT window_id, label, {rnd('e', 'entropy_hubness')} FROM he")
def _entropy(spark, sf):
    return rounded(quality.entropy_hubness(quality.hubness(_rows(spark, sf), _protos(spark, sf))))


@query("mean_entropy_hubness", f"WITH {HUBS} SELECT window_id, {rnd('avg(e)', 'entropy_hubness')} FROM he GROUP BY 1")
def _mean_entropy(spark, sf):
    hubs = quality.hubness(_rows(spark, sf), _protos(spark, sf))
    return rounded(quality.mean_entropy_hubness(quality.entropy_hubness(hubs)))


def _distribution(name: str, cond: str):
    @query(name, f"""WITH {TREE_RANK}
SELECT window_id, CAST(proto_id AS INTEGER) AS proto_id, {rnd('avg(m / {TREES}.0)', name)}
FROM rk WHERE {cond} GROUP BY 1, 2""")
    def _run(spark, sf):
        d = quality.distribution_similarity(_rows(spark, sf), _protos(spark, sf))
        return rounded(d.select("window_id", "proto_id", name))


_distribution("in_distribution", "label = y")
_distribution("out_distribution", "label <> y")
