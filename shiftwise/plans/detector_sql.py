"""The detectors as recursive SQL: one row of state per stream and position, for checking the folds."""

from __future__ import annotations

import math

from shiftwise.plans.inputs import ERROR_STREAMS

GRACE, SAMPLE = 3, 100
OUT, WARN = 0.001, 0.005


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _chained(init: str, steps: list[str], names: list[str], grace: int = GRACE, source: str = "es", extra: str = "") -> str:
    """Detections with history and chain.

    ``init`` sets the detector's state on a fresh start, ``steps`` are SELECT bodies, each reading the one before
    (``p`` first), and the last yields ``drift`` and ``warning`` next to the state columns ``names``.
    """
    state = ", ".join(names)
    fresh = ", ".join(f"CASE WHEN s.drift THEN f.{n} ELSE s.{n} END AS {n}" for n in names)
    body = f"SELECT s.stream, s.idx + 1 AS idx, e.error AS x{extra}, {fresh}, s.history, s.chain, s.lft, s.was " \
           f"FROM st s JOIN {source} e ON e.stream = s.stream AND e.idx = s.idx + 1, fr f"
    for step in steps:
        body = f"SELECT p.*, {step} FROM ({body}) p" if not step.startswith("REPLACE ") else \
            f"SELECT p.* REPLACE ({step[8:]}) FROM ({body}) p"
    kept = state if "warning" in names else f"{state}, warning"
    body = f"""SELECT stream, idx, {kept}, drift, history + 1 AS h,
      CASE WHEN warning THEN {grace} WHEN was THEN lft - 1 ELSE lft END AS l, chain, was FROM ({body}) p"""
    body = f"SELECT *, warning OR (was AND l > 0) AS alive FROM ({body}) p"
    return f"""fr AS (SELECT {init}),
st AS (
  SELECT stream, CAST(-1 AS BIGINT) AS idx, {', '.join(f'f.{n}' for n in names)}, false AS drift, CAST(0 AS BIGINT) AS history,
         CAST(0 AS BIGINT) AS chain, CAST({grace} AS BIGINT) AS lft, false AS was, CAST(0 AS BIGINT) AS found_h, CAST(0 AS BIGINT) AS found_c
  FROM (SELECT DISTINCT stream FROM es), fr f
  UNION ALL
  SELECT stream, idx, {state}, drift,
         CAST(CASE WHEN drift THEN 0 WHEN alive THEN h ELSE least(h, {SAMPLE}) END AS BIGINT),
         CAST(CASE WHEN drift THEN 0 WHEN alive THEN chain + 1 ELSE 0 END AS BIGINT),
         CAST(CASE WHEN drift THEN {grace} ELSE l END AS BIGINT), CASE WHEN drift THEN false ELSE alive END,
         CAST(h AS BIGINT), CAST(CASE WHEN alive THEN chain + 1 ELSE 0 END AS BIGINT)
  FROM ({body}) p)"""


def _query(cte: str) -> str:
    return f"""WITH RECURSIVE {ERROR_STREAMS},
{cte}
SELECT stream, idx AS detected_at, found_h AS history, found_c AS chain FROM st WHERE drift"""


DDM = _chained(
    "CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS e, CAST('inf' AS DOUBLE) AS pm, CAST('inf' AS DOUBLE) AS sm, CAST('inf' AS DOUBLE) AS lm",
    [
        "REPLACE n + 1 AS n, e + x AS e",
        "e / n AS rate",
        "sqrt(rate * (1 - rate) / n) AS sd",
        "n > 30 AS ready",
        "REPLACE CASE WHEN ready AND rate + sd <= lm THEN rate ELSE pm END AS pm, "
        "CASE WHEN ready AND rate + sd <= lm THEN sd ELSE sm END AS sm, "
        "CASE WHEN ready AND rate + sd <= lm THEN rate + sd ELSE lm END AS lm",
        "ready AND rate + sd > pm + 3 * sm AS drift",
        "ready AND NOT drift AND rate + sd > pm + 2 * sm AS warning",
    ],
    ["n", "e", "pm", "sm", "lm"],
)

EDDM = _chained(
    "CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS la, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS sp, "
    "CAST(0 AS DOUBLE) AS best, false AS warning",
    [
        "REPLACE n + 1 AS n, e + x AS e",
        "n - la AS gap",
        "m AS m0",
        "REPLACE CASE WHEN x = 1 THEN m + (gap - m) / e ELSE m END AS m",
        "REPLACE CASE WHEN x = 1 THEN sp + (gap - m) * (gap - m0) ELSE sp END AS sp, CASE WHEN x = 1 THEN n ELSE la END AS la",
        "m + 2 * sqrt(sp / greatest(e, 1)) AS level",
        "x = 1 AND n >= 30 AS ready",
        "ready AND level <= best AS below",
        "REPLACE CASE WHEN ready AND level > best THEN level ELSE best END AS best",
        "below AND e > 30 AND level / best < 0.9 AS drift",
        "REPLACE CASE WHEN below THEN e > 30 AND NOT drift AND level / best < 0.95 ELSE warning END AS warning",
    ],
    ["n", "e", "la", "m", "sp", "best", "warning"],
)

_LOG = math.log(1 / OUT) / 2
_RISEN = ("n_min <> n AND c / n - c_min / n_min >= sqrt((n - n_min) / n_min / n / 2 * {})")
HDDM_A_STEPS = [
    "REPLACE n + 1 AS n, c + x AS c",
    "REPLACE CASE WHEN n_min = 0 THEN c ELSE c_min END AS c_min, CASE WHEN n_min = 0 THEN n ELSE n_min END AS n_min",
    f"c_min / n_min + sqrt({_d(_LOG)} / n_min) >= c / n + sqrt({_d(_LOG)} / n) AS lower",
    "REPLACE CASE WHEN lower THEN c ELSE c_min END AS c_min, CASE WHEN lower THEN n ELSE n_min END AS n_min",
    _RISEN.format(_d(math.log(2 / OUT))) + " AS drift",
    "NOT drift AND " + _RISEN.format(_d(math.log(2 / WARN))) + " AS warning",
]
HDDM_A_INIT = "CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS n_min, CAST(0 AS DOUBLE) AS c_min"
HDDM_A = _chained(HDDM_A_INIT, HDDM_A_STEPS, ["n", "c", "n_min", "c_min"])
HDDM_A_20 = _chained(HDDM_A_INIT, HDDM_A_STEPS, ["n", "c", "n_min", "c_min"], grace=20)

_W = 0.05
_AFTER = "a_m IS NOT NULL AND b_m IS NOT NULL AND a_m - b_m > sqrt((a_s + b_s) * {} / 2)"
HDDM_W = _chained(
    "CAST(NULL AS DOUBLE) AS t_m, CAST(NULL AS DOUBLE) AS t_s, CAST(NULL AS DOUBLE) AS b_m, CAST(NULL AS DOUBLE) AS b_s, "
    "CAST(NULL AS DOUBLE) AS a_m, CAST(NULL AS DOUBLE) AS a_s, CAST('inf' AS DOUBLE) AS cut",
    [
        f"REPLACE coalesce({_d(_W)} * x + {_d(1 - _W)} * t_m, CAST(x AS DOUBLE)) AS t_m, "
        f"coalesce({_d(_W**2)} + {_d((1 - _W) ** 2)} * t_s, CAST(1 AS DOUBLE)) AS t_s",
        f"t_m + sqrt(t_s * {_d(math.log(1 / OUT))} / 2) AS level",
        "level < cut AS lower",
        f"REPLACE CASE WHEN lower THEN t_m ELSE b_m END AS b_m, CASE WHEN lower THEN t_s ELSE b_s END AS b_s, "
        f"CASE WHEN lower THEN NULL ELSE coalesce({_d(_W)} * x + {_d(1 - _W)} * a_m, CAST(x AS DOUBLE)) END AS a_m, "
        f"CASE WHEN lower THEN NULL ELSE coalesce({_d(_W**2)} + {_d((1 - _W) ** 2)} * a_s, CAST(1 AS DOUBLE)) END AS a_s, "
        "CASE WHEN lower THEN level ELSE cut END AS cut",
        _AFTER.format(_d(math.log(1 / OUT))) + " AS drift",
        "NOT drift AND " + _AFTER.format(_d(math.log(1 / WARN))) + " AS warning",
    ],
    ["t_m", "t_s", "b_m", "b_s", "a_m", "a_s", "cut"],
)

FHDDM = "er AS (SELECT *, avg(error) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rate FROM es),\n" + _chained(
    "CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS best",
    [
        "REPLACE n + 1 AS n",
        "REPLACE CASE WHEN n >= 100 THEN greatest(best, 1 - rate) ELSE best END AS best",
        f"n >= 100 AND best - (1 - rate) > {_d(math.sqrt(math.log(1 / 0.001) / 200))} AS drift, false AS warning",
    ],
    ["n", "best"], source="er", extra=", e.rate",
)

DETECTOR_SQL = {"fhddm": _query(FHDDM), "ddm": _query(DDM), "eddm": _query(EDDM), "hddm_a": _query(HDDM_A), "hddm_w": _query(HDDM_W)}
CHAIN_SQL = _query(HDDM_A_20)
