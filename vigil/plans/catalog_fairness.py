"""Catalog: fairness audit (l01-l12)."""

from __future__ import annotations

from vigil.operators import fairness as L
from vigil.plans.registry import query
from vigil.sources import fixtures as fx
from vigil.sources.fixture_sql import with_views

ATTRS = ["lang", "source"]
EDGES = L.CAL_EDGES


def _long_sql(view: str, attrs: list[str], cols: str = "y_true, y_pred, y_prob") -> str:
    return "\nUNION ALL\n".join(f"SELECT {cols}, '{a}' AS attribute, CAST({a} AS VARCHAR) AS \"group\" FROM {view} "
                                f"WHERE {a} IS NOT NULL" for a in attrs)


def _groups_sql(view: str, attrs: list[str]) -> str:
    return f"""SELECT attribute, "group", count(*)::BIGINT AS n,
       avg(coalesce(y_pred = 1, false)::INTEGER::DOUBLE) AS positive_rate,
       count(*) FILTER (WHERE y_pred = 1 AND y_true = 1) / nullif(count(*) FILTER (WHERE y_true = 1), 0) AS tpr,
       count(*) FILTER (WHERE y_pred = 1 AND coalesce(y_true <> 1, true)) / nullif(count(*) FILTER (WHERE coalesce(y_true <> 1, true)), 0) AS fpr,
       count(*) FILTER (WHERE y_pred = 1 AND y_true = 1) / nullif(count(*) FILTER (WHERE y_pred = 1), 0) AS ppv
FROM ({_long_sql(view, attrs)}) l GROUP BY attribute, "group\""""


def _cal_sql(view: str, attrs: list[str]) -> str:
    idx = " + ".join(f"(y_prob >= {e!r})::INTEGER" for e in EDGES) + " - 1"
    return f"""SELECT attribute, "group", sum(cnt)::BIGINT AS n_samples,
       avg(CASE WHEN bin >= 0 AND bin < 10 THEN abs(t - q) END) AS ece
FROM (SELECT attribute, "group", {idx} AS bin, count(*) AS cnt, avg(y_true::DOUBLE) AS t, avg(y_prob) AS q
      FROM ({_long_sql(view, attrs)}) l GROUP BY ALL) b GROUP BY attribute, "group\""""


def _summary_sql(view: str, attrs: list[str], dp_limit: float = 0.1) -> str:
    return f"""
WITH g AS ({_groups_sql(view, attrs)}), c AS ({_cal_sql(view, attrs)}),
a AS (SELECT attribute,
        CASE WHEN count(positive_rate) >= 1 THEN max(positive_rate) - min(positive_rate) END AS dp,
        CASE WHEN count(tpr) >= 2 THEN max(tpr) - min(tpr) END AS eo,
        CASE WHEN count(fpr) >= 2 THEN max(fpr) - min(fpr) END AS fpr_s,
        CASE WHEN max(positive_rate) > 0 THEN min(positive_rate) / max(positive_rate) ELSE 0.0 END AS di,
        CASE WHEN count(ppv) >= 2 THEN max(ppv) - min(ppv) END AS pp,
        CASE WHEN count(ece) >= 2 THEN max(ece) - min(ece) END AS cal
      FROM g LEFT JOIN c USING (attribute, "group") GROUP BY attribute)
SELECT attribute, 'demographic_parity' AS metric, dp AS value, NULL::DOUBLE AS fpr_value, dp <= {dp_limit} AS passes FROM a
UNION ALL SELECT attribute, 'equal_opportunity', eo, NULL, eo <= 0.1 FROM a
UNION ALL SELECT attribute, 'equalized_odds', eo, fpr_s, eo <= 0.1 AND fpr_s <= 0.1 FROM a
UNION ALL SELECT attribute, 'disparate_impact', di, NULL, di >= 0.8 FROM a
UNION ALL SELECT attribute, 'predictive_parity', pp, NULL, pp <= 0.1 FROM a
UNION ALL SELECT attribute, 'calibration', cal, NULL, NULL::BOOLEAN FROM a"""


SUM_D = ("value", "fpr_value")


@query("l01_l05_group_rates", doubles=("positive_rate", "tpr", "fpr", "ppv"),
       oracle=with_views(_groups_sql("scored", ATTRS), "scored"))
def l01(t):
    """Positive rate, TPR, FPR and PPV for every group of every sensitive attribute, one pass."""
    return L.group_rates(fx.scored(t), ATTRS)


@query("l06_calibration_by_group", doubles=("ece",), oracle=with_views(_cal_sql("scored", ATTRS), "scored"))
def l06(t):
    return L.calibration_by_group(fx.scored(t), ATTRS)


@query("l07_fairness_summary", doubles=SUM_D, oracle=with_views(_summary_sql("scored", ATTRS), "scored"))
def l07(t):
    """All metrics x all sensitive attributes (parity, opportunity, odds, impact, precision, calibration)."""
    return L.fairness_summary(fx.scored(t), ATTRS)


@query("l02_l03_planted_bias", doubles=SUM_D, oracle=with_views(_summary_sql("scored_biased", ["lang"]),
                                                                "scored_biased"))
def l02(t):
    """Planted bias (30 % of French positives forced negative): the TPR spread must show it."""
    return L.fairness_summary(fx.scored_biased(t), ["lang"])


_INTER = "SELECT *, concat_ws('_', lang, source) AS lang_source FROM scored"


@query("l08_intersectional", doubles=SUM_D, oracle=with_views(_summary_sql("inter", ["lang_source"], 0.15),
                                                              "scored", ctes=[("inter", _INTER)]))
def l08(t):
    s = L.intersectional(fx.scored(t), ["lang", "source"])
    return L.fairness_summary(s, ["lang_source"], parity_limit=0.15)


@query("l09_compliance_violations", doubles=("value", "threshold"), oracle=with_views(f"""
SELECT attribute, metric, value, CASE metric WHEN 'demographic_parity' THEN 0.1 WHEN 'equal_opportunity' THEN 0.1
       ELSE 0.8 END AS threshold
FROM ({_summary_sql("scored_biased", ATTRS)}) s
WHERE coalesce((metric = 'demographic_parity' AND value > 0.1) OR (metric = 'equal_opportunity' AND value > 0.1)
               OR (metric = 'disparate_impact' AND value < 0.8), false)""", "scored_biased"))
def l09(t):
    return L.compliance_violations(L.fairness_summary(fx.scored_biased(t), ATTRS))


@query("l10_severe_bias", doubles=SUM_D, oracle=with_views(f"""
SELECT * FROM ({_summary_sql("scored_biased", ATTRS)}) s
WHERE metric IN ('demographic_parity', 'equal_opportunity', 'predictive_parity') AND value > 0.2""", "scored_biased"))
def l10(t):
    return L.severe_bias(L.fairness_summary(fx.scored_biased(t), ATTRS))


@query("l11_audit_report", doubles=SUM_D, oracle=with_views(f"""
SELECT '2024-02-01 00:00:00' AS audit_ts, (SELECT count(*) FROM scored)::BIGINT AS n_samples,
       'lang,source' AS attributes, s.* FROM ({_summary_sql("scored", ATTRS)}) s""", "scored"))
def l11(t):
    s = fx.scored(t)
    return L.audit_report(s, L.fairness_summary(s, ATTRS), ATTRS, "2024-02-01 00:00:00")


_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


@query("l12_group_thresholds", doubles=("threshold", "positive_rate", "target_rate"), oracle=with_views(f"""
WITH l AS ({_long_sql("scored", ATTRS, "y_prob, y_pred")}),
x AS (SELECT attribute, "group", t.threshold, count(*) FILTER (WHERE y_prob >= t.threshold) / count(*) AS rate
      FROM l, (VALUES {", ".join(f"({g!r})" for g in _GRID)}) t(threshold) GROUP BY ALL),
tg AS (SELECT avg(coalesce(y_pred = 1, false)::INTEGER::DOUBLE) AS target FROM scored)
SELECT attribute, "group", arg_min(threshold, (abs(rate - target), threshold)) AS threshold,
       arg_min(rate, (abs(rate - target), threshold)) AS positive_rate, max(target) AS target_rate
FROM x, tg GROUP BY attribute, "group\"""", "scored"))
def l12(t):
    """Group-wise decision thresholds matching the overall positive rate (post-processing mitigation)."""
    return L.group_thresholds(fx.scored(t), ATTRS, grid=_GRID)


@query("l12_equalised_odds")
def l12_odds(t):
    """Randomised thresholds per language with equal TPR and FPR, from the groups' ROC hulls."""
    return L.equalised_odds(fx.scored_biased(t), "lang")


_METRIC_IDS = {"l01_demographic_parity": "demographic_parity", "l02_equal_opportunity": "equal_opportunity",
               "l03_equalized_odds": "equalized_odds", "l04_disparate_impact": "disparate_impact",
               "l05_predictive_parity": "predictive_parity"}


def _metric_query(qid: str, metric: str):
    @query(qid, doubles=SUM_D, oracle=with_views(
        f"SELECT * FROM ({_summary_sql('scored', ATTRS)}) s WHERE metric = '{metric}'", "scored"))
    def q(t):
        return L.fairness_summary(fx.scored(t), ATTRS, prob=None).where(f"metric = '{metric}'")
    q.__doc__ = f"{metric.replace('_', ' ')} per sensitive attribute (spread / ratio and pass flag)."
    return q


for _qid, _metric in _METRIC_IDS.items():
    _metric_query(_qid, _metric)
