"""T1-T7 on the given tables."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from shiftwise.operators import two_sample
from shiftwise.plans.catalog import query, rnd, rounded
from shiftwise.plans.inputs import LINE_FEATURES, LINE_ORDER, LINE_SIDES, line_sides

CDFS = f"""{LINE_SIDES},
sc AS (SELECT label, feature, value, count(*) FILTER (side = 'before') AS nb, count(*) FILTER (side = 'after') AS na
       FROM long GROUP BY 1, 2, 3),
cd AS (SELECT *, sum(nb) OVER w AS cb, sum(na) OVER w AS ca, lead(value) OVER w AS nxt,
              CAST(sum(nb) OVER g AS DOUBLE) AS tb, CAST(sum(na) OVER g AS DOUBLE) AS ta
       FROM sc WINDOW w AS (PARTITION BY label, feature ORDER BY value), g AS (PARTITION BY label, feature))"""

TAIL = " + ".join(f"({(-1.0) ** (k - 1)}) * exp(-{2.0 * k * k} * t * t)" for k in range(1, 21))
KS = f"""{CDFS},
ks0 AS (SELECT label, feature, max(abs(cb / tb - ca / ta)) AS stat, sqrt(max(tb) * max(ta) / (max(tb) + max(ta))) AS en
        FROM cd GROUP BY 1, 2),
ks1 AS (SELECT *, en * stat AS t FROM ks0),
ks AS (SELECT label, feature, stat,
              CASE WHEN t < 0.3 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * ({TAIL}))) END AS p_value FROM ks1)"""

BINS = f"""{CDFS},
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long WHERE side = 'before' GROUP BY 1),
sv AS (SELECT label, feature, nb, na, value * (1.0 / (hi - lo)) + (-lo * (1.0 / (hi - lo))) AS v
       FROM sc JOIN rg USING (feature)),
ed AS (SELECT label, feature, min(v) AS a, max(v) AS b, (max(v) - min(v)) / 30 AS step
       FROM sv WHERE nb > 0 GROUP BY 1, 2),
gs AS (SELECT *, least(floor((v - a) / step), 29) AS g FROM sv JOIN ed USING (label, feature) WHERE v >= a AND v <= b),
ht AS (SELECT *, CASE WHEN v < g * step + a THEN g - 1 WHEN v >= (g + 1) * step + a AND g < 29 THEN g + 1 ELSE g END AS bin
       FROM gs),
bc AS (SELECT label, feature, bin, sum(nb) AS nb, sum(na) AS na FROM ht GROUP BY 1, 2, 3),
bt AS (SELECT label, feature, sum(nb) AS tb, sum(na) AS ta FROM bc GROUP BY 1, 2),
de AS (SELECT e.label, e.feature, coalesce(nb, 0) / (tb * step) + 1e-10 AS p, coalesce(na, 0) / (ta * step) + 1e-10 AS q
       FROM ed e JOIN bt USING (label, feature) CROSS JOIN range(30) r
       LEFT JOIN bc ON bc.label = e.label AND bc.feature = e.feature AND bc.bin = r.range),
pq AS (SELECT label, feature, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q
       FROM de WINDOW w AS (PARTITION BY label, feature)),
dv AS (SELECT label, feature, sum(p * ln(p / q)) AS kl,
              sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 AS js FROM pq GROUP BY 1, 2)"""

WD = f"""{CDFS}, rg AS (SELECT feature, max(value) - min(value) AS span FROM long WHERE side = 'before' GROUP BY 1),
wd AS (SELECT label, feature, sum(abs(cb / tb - ca / ta) * (nxt - value)) / max(span) AS stat
       FROM cd JOIN rg USING (feature) GROUP BY 1, 2)"""

SPEARMAN = f"""{LINE_SIDES},
po AS (SELECT *, row_number() OVER (PARTITION BY side, label ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos
       FROM li),
pl AS (SELECT side, label, pos, 'l_quantity' AS feature, l_quantity AS value FROM po
       UNION ALL SELECT side, label, pos, 'l_extendedprice', l_extendedprice FROM po
       UNION ALL SELECT side, label, pos, 'l_discount', l_discount FROM po
       UNION ALL SELECT side, label, pos, 'l_tax', l_tax FROM po),
xy AS (SELECT o.label, o.feature, o.value AS x, n.value AS y FROM pl o JOIN pl n
       ON o.label = n.label AND o.feature = n.feature AND o.pos = n.pos AND o.side = 'before' AND n.side = 'after'),
rk AS (SELECT label, feature,
              rank() OVER (PARTITION BY label, feature ORDER BY x) + (count(*) OVER (PARTITION BY label, feature, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY label, feature ORDER BY y) + (count(*) OVER (PARTITION BY label, feature, y) - 1) / 2.0 AS ry
       FROM xy),
sp AS (SELECT label, feature, corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS stat FROM rk GROUP BY 1, 2)"""

AD = f"""{CDFS},
mr AS (SELECT *, tb + ta AS t, CAST(nb + na AS DOUBLE) AS l, cb + ca - (nb + na) / 2.0 AS b FROM cd),
ad AS (SELECT label, feature,
              sum(CASE WHEN b * (t - b) - t * l / 4 > 0 THEN
                  l / t * pow(t * (cb - nb / 2.0) - b * tb, 2) / (b * (t - b) - t * l / 4) / tb +
                  l / t * pow(t * (ca - na / 2.0) - b * ta, 2) / (b * (t - b) - t * l / 4) / ta ELSE 0 END)
              * max((t - 1) / t) AS raw, CAST(max(tb) AS BIGINT) AS n1, CAST(max(ta) AS BIGINT) AS n2 FROM mr GROUP BY 1, 2)"""


def _cdf_summary(spark, sf):
    return two_sample.cdf_summary(two_sample.side_cdfs(line_sides(spark, sf), LINE_FEATURES))


@query("ks_test", f"""WITH {KS}
SELECT label, feature, 'kolmogorov_smirnov' AS test, {rnd('stat', 'stat')}, {rnd('p_value', 'p_value')},
       p_value < 0.05 AS drift FROM ks""")
def _ks(spark, sf):
    return rounded(two_sample.ks_test(_cdf_summary(spark, sf)))


@query("kl_divergence", f"""WITH {BINS}
SELECT label, feature, 'kullback_leibler' AS test, {rnd('kl', 'stat')}, CAST(NULL AS DOUBLE) AS p_value,
       kl > 0.1 AS drift FROM dv""")
def _kl(spark, sf):
    binned = two_sample.side_bins(line_sides(spark, sf), LINE_FEATURES)
    return rounded(two_sample.kl_divergence(two_sample.divergences(binned)))


@query("js_divergence", f"""WITH {BINS}
SELECT label, feature, 'jensen_shannon' AS test, {rnd('js', 'stat')}, CAST(NULL AS DOUBLE) AS p_value,
       js > 0.05 AS drift FROM dv""")
def _js(spark, sf):
    binned = two_sample.side_bins(line_sides(spark, sf), LINE_FEATURES)
    return rounded(two_sample.js_divergence(two_sample.divergences(binned)))


@query("wasserstein", f"""WITH {WD}
SELECT label, feature, 'wasserstein' AS test, {rnd('stat', 'stat')}, CAST(NULL AS DOUBLE) AS p_value,
       stat > 0.1 AS drift FROM wd""")
def _wd(spark, sf):
    ranges = two_sample.feature_ranges(line_sides(spark, sf), LINE_FEATURES)
    return rounded(two_sample.wasserstein(_cdf_summary(spark, sf), ranges))


@query("spearman_paired", f"""WITH {SPEARMAN}
SELECT label, feature, 'spearman' AS test, {rnd('stat', 'stat')}, CAST(NULL AS DOUBLE) AS p_value,
       abs(stat) < 0.9 AS drift FROM sp""")
def _spearman(spark, sf):
    return rounded(two_sample.spearman_paired(line_sides(spark, sf, order=True), LINE_FEATURES, LINE_ORDER))


@query("anderson_darling_raw", f"WITH {AD} SELECT label, feature, {rnd('raw', 'raw')}, n1, n2 FROM ad")
def _ad_raw(spark, sf):
    return rounded(_cdf_summary(spark, sf).select("label", "feature", "raw", "n1", "n2"))


FIT = [float(c) for c in np.polyfit(two_sample.AD_CRITICAL, np.log(two_sample.AD_LEVELS), 2)]
AD_FULL = f"""{AD},
ad_nn AS (SELECT DISTINCT n1 + n2 AS t FROM ad),
ad_hs AS (SELECT t, r.range AS i, sum(1.0 / CAST(r.range AS DOUBLE)) OVER (PARTITION BY t ORDER BY r.range) AS h
       FROM ad_nn, range(1, (SELECT max(t) FROM ad_nn)) r WHERE r.range < t),
ad_ht AS (SELECT t, max(h) AS h FROM ad_hs GROUP BY 1),
ad_gs AS (SELECT ad_hs.t, max(ad_ht.h) AS h, sum((ad_ht.h - ad_hs.h) / (ad_hs.t - i)) AS g FROM ad_hs JOIN ad_ht USING (t) WHERE i <= ad_hs.t - 2 GROUP BY 1),
ad_ab AS (SELECT label, feature, raw, CAST(t AS DOUBLE) AS t, g, h, 1.0 / n1 + 1.0 / n2 AS inv FROM ad JOIN ad_gs ON ad_gs.t = n1 + n2),
ad_sg AS (SELECT *, sqrt((((4 * g - 6) + (10 - 6 * g) * inv) * t * t * t
              + ((2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * inv - 8 * h + 4 * g - 6) * t * t
              + ((6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * inv + 4 * h) * t
              + (2 * h + 6) * 4 - 8 * h) / ((t - 1) * (t - 2) * (t - 3))) AS sigma FROM ad_ab),
ad_aa AS (SELECT label, feature, (raw - 1) / sigma AS stat FROM ad_sg),
ap AS (SELECT *, CASE WHEN stat < {two_sample.AD_CRITICAL[0]} THEN 0.25 WHEN stat > {two_sample.AD_CRITICAL[-1]} THEN 0.001
              ELSE exp({FIT[0]} * stat * stat + {FIT[1]} * stat + {FIT[2]}) END AS p_value FROM ad_aa)"""


@query("anderson_darling_k", f"""WITH {AD_FULL}
SELECT label, feature, 'anderson_darling' AS test, {rnd('stat', 'stat', 5)}, {rnd('p_value', 'p_value', 5)}, p_value < 0.05 AS drift,
       '{",".join(map(str, two_sample.AD_CRITICAL))}' AS critical FROM ap""")
def _ad(spark, sf):
    found = rounded(two_sample.anderson_darling_k(_cdf_summary(spark, sf)), 5)
    return found.withColumn("critical", F.array_join(F.col("critical").cast("array<string>"), ","))


DECIDE = f"""al AS (
  SELECT 'kolmogorov_smirnov' AS test, p_value < 0.05 AS drift FROM ks
  UNION ALL SELECT 'kullback_leibler', kl > 0.1 FROM dv
  UNION ALL SELECT 'jensen_shannon', js > 0.05 FROM dv
  UNION ALL SELECT 'wasserstein', stat > 0.1 FROM wd
  UNION ALL SELECT 'spearman', abs(stat) < 0.9 FROM sp
  UNION ALL SELECT 'anderson_darling', p_value < 0.05 FROM ap),
fl AS (SELECT test, avg(CASE WHEN drift THEN 1.0 ELSE 0.0 END) > 0.2 AS drift FROM al GROUP BY 1)"""


def _joined(*parts: str) -> str:
    """Concatenate CTE lists, each name once."""
    seen, out = set(), []
    for part in parts:
        for cte in re.split(r",\s*(?=\w+ AS \()", part):
            name = cte.split(" AS (")[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(cte)
    return ",\n".join(out)


@query("test_decision", f"""WITH {_joined(KS, BINS, WD.replace(CDFS + ', rg AS', 'rw AS').replace('JOIN rg', 'JOIN rw'), SPEARMAN, AD_FULL, DECIDE)}
SELECT count(*) AS tests, {rnd('avg(CASE WHEN drift THEN 1.0 ELSE 0.0 END)', 'drifted_share')},
       avg(CASE WHEN drift THEN 1.0 ELSE 0.0 END) > 0.4 AS drift FROM fl""")
def _decision(spark, sf):
    return rounded(two_sample.test_decision(two_sample.run_tests(line_sides(spark, sf, order=True), LINE_FEATURES, LINE_ORDER)))
