"""Metrics and thresholds of scored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import metrics as M
from ..operators import thresholds as T
from . import views as V
from .registry import query


def _truth():
    return F.col("truth")


def _flag():
    return F.col("pred_attack")


@query(f"WITH {V.TEST} SELECT {V.counted('pred_attack')} FROM test")
def confusion(spark, d):
    return V.judged(spark, d, "test", "pred_attack").agg(*M.counts(_truth(), _flag()))


@query(f"WITH {V.TEST}, c AS (SELECT {V.counted('pred_attack')} FROM test) SELECT tp, fn, fp, tn, {V.BLOCK} FROM c")
def metric_block(spark, d):
    return V.judged(spark, d, "test", "pred_attack").agg(*M.counts(_truth(), _flag())).select("*", *M.metric_block())


_LOW, _HIGH = V.base_rate(f"coalesce({V.wilson('tp', '(tp + fn)', '-')}, 0)", f"coalesce({V.wilson('fp', '(fp + tn)', '+')}, 0)", 100), V.base_rate(f"coalesce({V.wilson('tp', '(tp + fn)', '+')}, 0)", f"coalesce({V.wilson('fp', '(fp + tn)', '-')}, 0)", 100)


@query(f"WITH {V.TEST}, c AS (SELECT bypass_class, {V.counted('pred_attack')} FROM test GROUP BY 1) SELECT bypass_class, round({_LOW}, 9) AS precision_100_low, round({_HIGH}, 9) AS precision_100_high FROM c")
def precision_interval(spark, d):
    return V.judged(spark, d, "test").groupBy("bypass_class").agg(*M.counts(_truth(), _flag())).select("bypass_class", *M.precision_interval(100))


@query(f"WITH {V.TEST}, c AS ({V.by_fields('test', V.FIELDS, V.counted('pred_attack'))}) SELECT field, value, tp, fn, fp, tn, {V.BLOCK} FROM c")
def breakdown_sets(spark, d):
    return M.breakdown(V.judged(spark, d, "test"), V.FIELDS, _truth(), _flag())


@query(f"WITH {V.BOTH}, tau AS (SELECT max(margin) FILTER (NOT truth) AS tau FROM val), p AS (SELECT *, margin > tau AS pred FROM test, tau), c AS ({V.by_fields('p', V.FIELDS, V.counted('pred'))}) SELECT field, value, tp, fn, fp, tn, {V.BLOCK} FROM c")
def frozen_evaluation(spark, d):
    """The threshold is chosen on validation and applied once to test."""
    tau = T.zero_fp_max(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin").withColumn("_one", F.lit(1))
    test = V.judged(spark, d, "test").withColumn("_one", F.lit(1)).join(F.broadcast(tau), "_one")
    return M.breakdown(test, V.FIELDS, _truth(), F.col("margin") > F.col("tau"))


_TALLY = "count(*) AS rows, count(*) FILTER (label = 'attack') AS attacks, count(*) FILTER (coalesce(pred_attack, false)) AS flagged"


@query(f"WITH {V.S} {V.by_fields('scored', ('split', 'attack_class', 'benign_subclass', 'bypass_class'), _TALLY)}")
def tally_sets(spark, d):
    sums = [F.count("*").alias("rows"), F.count_if(F.col("label") == "attack").alias("attacks"), F.count_if(C.true("pred_attack")).alias("flagged")]
    return M.long_counts(V.scored(spark, d), ("split", "attack_class", "benign_subclass", "bypass_class"), sums)


@query(f"WITH {V.S} SELECT coalesce(split, 'missing') AS split, coalesce(label, 'missing') AS label, count(*) AS rows FROM scored GROUP BY 1, 2")
def row_summary(spark, d):
    miss = lambda c: F.coalesce(c, F.lit("missing")).alias(c)
    return V.scored(spark, d).groupBy(miss("split"), miss("label")).agg(F.count("*").alias("rows"))


@query(f"WITH {V.TEST} SELECT attack_class, count(*) FILTER (pred_attack) AS caught, count(*) AS total, round(count(*) FILTER (pred_attack)::double / count(*), 9) AS rate FROM test WHERE truth GROUP BY 1")
def catch_by_group(spark, d):
    caught = F.count_if(C.true("pred_attack"))
    return V.judged(spark, d, "test").where("truth").groupBy("attack_class").agg(caught.alias("caught"), F.count("*").alias("total"), F.round(caught / F.count("*"), 9).alias("rate"))


_RULE_SQL = {"r1_untrusted_tool": V.R1, "r2_sink_not_user": V.R2, "r3_untrusted_tool_sink": f"({V.R1}) AND coalesce(contains_sensitive_sink, false)", "r4_union": f"({V.R1}) OR {V.R2}",
             "any_handle": "coalesce(trust_level = 'untrusted', false) OR coalesce(requires_tool_call, false) OR coalesce(contains_sensitive_sink, false) OR coalesce(source_type = 'tool_result', false)"}
_RATE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS control, bypass_class, count(*) FILTER ({c}) AS hits, count(*) AS total FROM test GROUP BY bypass_class" for n, c in _RULE_SQL.items())


@query(f"WITH {V.TEST}, c AS ({_RATE_ROWS}) SELECT control, bypass_class, hits, total, round(hits::double / total, 9) AS rate, round({V.wilson('hits', 'total', '-')}, 9) AS low, round({V.wilson('hits', 'total', '+')}, 9) AS high FROM c")
def control_rate_table(spark, d):
    sums = V.judged(spark, d, "test").groupBy("bypass_class").agg(F.count("*").alias("total"), *(F.count_if(rule()).alias(n) for n, rule in C.RULES.items()))
    long = sums.select("bypass_class", "total", F.explode(F.array(*(F.struct(F.lit(n).alias("control"), F.col(n).alias("hits")) for n in C.RULES))).alias("c")).select("c.control", "bypass_class", "c.hits", "total")
    hits, total = F.col("hits"), F.col("total")
    return long.select("*", F.round(hits / total, 9).alias("rate"), F.round(M.wilson(hits, total, -1), 9).alias("low"), F.round(M.wilson(hits, total, 1), 9).alias("high"))


@query(f"WITH {V.TEST}, g AS (SELECT benign_subclass, round(avg(coalesce(pred_attack, false)::int), 9) AS rate FROM test WHERE NOT truth GROUP BY 1) SELECT max(rate) AS worst_rate, max_by(benign_subclass, (rate, benign_subclass)) AS worst_group FROM g")
def worst_group(spark, d):
    g = V.judged(spark, d, "test").where(~_truth()).groupBy("benign_subclass").agg(F.round(F.avg(C.true("pred_attack").cast("int")), 9).alias("rate"))
    return g.agg(F.max("rate").alias("worst_rate"), F.max_by("benign_subclass", F.struct("rate", "benign_subclass")).alias("worst_group"))


_LANE = "CASE WHEN margin < -0.1 THEN 'pass' WHEN margin > 0.05 THEN 'flag' ELSE 'uncertain' END"


def _lanes(df):
    return df.withColumn("lane", F.when(F.col("margin") < -0.1, "pass").when(F.col("margin") > 0.05, "flag").otherwise("uncertain"))


@query(f"WITH {V.TEST}, l AS (SELECT {_LANE} AS lane, label FROM test) SELECT lane, count(*) FILTER (label = 'attack') AS attack, count(*) FILTER (label = 'benign') AS benign FROM l GROUP BY 1")
def lane_counts(spark, d):
    return _lanes(V.judged(spark, d, "test", "pred_attack")).groupBy("lane").pivot("label", ["attack", "benign"]).agg(F.count("margin")).fillna(0, ["attack", "benign"])


@query(f"WITH {V.TEST}, l AS (SELECT {_LANE} AS lane, truth FROM test), t AS (SELECT count(*) FILTER (truth) AS a, count(*) FILTER (NOT truth) AS b, count(*) FILTER (truth AND lane = 'uncertain') AS ua, count(*) FILTER (NOT truth AND lane = 'uncertain') AS ub FROM l) SELECT round({V.base_rate(V.ratio('ua', 'a'), V.ratio('ub', 'b'), 1000)}, 9) AS precision_1000, round({V.base_rate(V.ratio('ua', 'a'), V.ratio('ub', 'b'), 100)}, 9) AS precision_100 FROM t")
def queue_precision(spark, d):
    held, t = F.col("lane") == "uncertain", _truth()
    s = _lanes(V.judged(spark, d, "test", "pred_attack")).agg(F.count_if(t).alias("a"), F.count_if(~t).alias("b"), F.count_if(t & held).alias("ua"), F.count_if(~t & held).alias("ub"))
    rates = M.ratio(F.col("ua"), F.col("a")), M.ratio(F.col("ub"), F.col("b"))
    return s.select(*(F.round(M.base_rate_precision(*rates, n), 9).alias(f"precision_{n}") for n in (1000, 100)))


@query(f"WITH {V.TEST}, l AS (SELECT {_LANE} AS lane FROM test WHERE NOT truth), t AS (SELECT count(*) FILTER (lane <> 'pass') AS escaped, count(*) AS total FROM l) SELECT escaped, total, round({V.ratio('escaped', 'total')}, 9) AS rate, {V.wilson('escaped', 'total', '-')} <= 0.3 AND {V.wilson('escaped', 'total', '+')} >= 0.3 AS target_inside FROM t")
def coverage(spark, d):
    s = _lanes(V.judged(spark, d, "test", "pred_attack")).where(~_truth()).agg(F.count_if(F.col("lane") != "pass").alias("escaped"), F.count("*").alias("total"))
    e, n = F.col("escaped"), F.col("total")
    return s.select("*", F.round(M.ratio(e, n), 9).alias("rate"), ((M.wilson(e, n, -1) <= 0.3) & (M.wilson(e, n, 1) >= 0.3)).alias("target_inside"))


@query(f"WITH {V.TEST} SELECT round(avg(pow(greatest(0, least(1, margin * 2 + 0.5)) - truth::int, 2)), 9) AS brier FROM test")
def brier(spark, d):
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("margin") * 2 + 0.5))
    return M.brier(V.judged(spark, d, "test", "pred_attack"), _truth(), p)


@query(f"WITH {V.TEST}, l AS (SELECT {_LANE} AS lane, truth, coalesce(pred_attack, false) AS p FROM test) SELECT round(avg((NOT p)::int) FILTER (truth AND lane = 'pass') / nullif(avg((NOT p)::int) FILTER (truth), 0), 9) AS miss_overlap, round(avg(p::int) FILTER (NOT truth AND lane <> 'pass') / nullif(avg(p::int) FILTER (NOT truth), 0), 9) AS fp_overlap FROM l")
def overlap_ratio(spark, d):
    df, p = _lanes(V.judged(spark, d, "test", "pred_attack")), C.true("pred_attack")
    share = lambda v, c: F.avg(F.when(c, v.cast("int")))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 9)
    passed, t = F.col("lane") == "pass", _truth()
    return df.agg(ratio(share(~p, t & passed), share(~p, t)).alias("miss_overlap"), ratio(share(p, ~t & ~passed), share(p, ~t)).alias("fp_overlap"))


@query(f"WITH {V.TEST}, l AS (SELECT {_LANE} AS lane, truth, margin FROM test) SELECT lane, count(*) AS size, count(*) FILTER (truth) AS attacks, count(*) FILTER (NOT truth) AS benign, round(avg(margin), 8) AS mean_margin FROM l GROUP BY 1")
def lane_composition(spark, d):
    return _lanes(V.judged(spark, d, "test", "pred_attack")).groupBy("lane").agg(F.count("*").alias("size"), F.count_if(_truth()).alias("attacks"), F.count_if(~_truth()).alias("benign"), F.round(F.avg("margin"), 8).alias("mean_margin"))


@query(f"WITH {V.S} SELECT split, label, count(margin) AS n, round(min(margin), 9) AS low, round(quantile_cont(margin, 0.05), 9) AS p05, round(quantile_cont(margin, 0.5), 9) AS median, round(quantile_cont(margin, 0.95), 9) AS p95, round(max(margin), 9) AS high, round(avg(margin), 9) AS mean, round(stddev_pop(margin), 9) AS deviation FROM scored GROUP BY 1, 2")
def score_summary(spark, d):
    return M.score_summary(V.scored(spark, d), "margin", ["split", "label"])


_STEPS = "g AS (SELECT margin AS score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM {} GROUP BY 1), s AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS attacks, sum(n) OVER () AS benign FROM g)"


@query(f"WITH {V.TEST}, {_STEPS.format('test')} SELECT round(sum(n * (tp - p + p / 2.0::double)) / (max(attacks) * max(benign)), 9) AS roc_auc FROM s")
def roc_auc(spark, d):
    return M.roc_auc(V.judged(spark, d, "test", "pred_attack"), _truth(), "margin").select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"WITH {V.TEST}, {_STEPS.format('test')} SELECT round(sum(p::double / attacks * tp / (tp + fp)), 9) AS average_precision FROM s")
def average_precision(spark, d):
    return M.average_precision(V.judged(spark, d, "test", "pred_attack"), _truth(), "margin").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {V.S}, s AS (SELECT unnest(['exemplar_bank', 'validation', 'test']) AS split), l AS (SELECT unnest(['attack', 'benign']) AS label), c AS (SELECT split, label, count(*) AS n FROM scored GROUP BY 1, 2) SELECT split, label, coalesce(n, 0) AS rows FROM s CROSS JOIN l LEFT JOIN c USING (split, label)")
def label_coverage_grid(spark, d):
    return M.coverage_grid(V.scored(spark, d), "split", ("exemplar_bank", "validation", "test"), "label", ("attack", "benign"))


@query(f"WITH {V.TEST}, c AS (SELECT bypass_class, {V.counted('pred_attack')} FROM test GROUP BY 1) SELECT bypass_class, tp, round(tp - 0.1418::double * (tp + fn), 9) AS more_hits, fp, round(fp - 0.0::double * (fp + tn), 9) AS more_alarms FROM c")
def baseline_delta(spark, d):
    c = V.judged(spark, d, "test").groupBy("bypass_class").agg(*M.counts(_truth(), _flag()))
    return c.select("bypass_class", "tp", F.round(F.col("tp") - 0.1418 * (F.col("tp") + F.col("fn")), 9).alias("more_hits"), "fp", F.round(F.col("fp") - 0.0 * (F.col("fp") + F.col("tn")), 9).alias("more_alarms"))


@query(f"WITH {V.VAL}, t AS (SELECT benign_subclass, bypass_class, count(*) AS total, count(*) FILTER (margin > 0) AS hits, bool_or(truth) AS truth FROM val GROUP BY 1, 2) SELECT benign_subclass, bypass_class, total, hits, round({V.wilson('hits', 'total', '-')}, 9) AS low, round({V.wilson('hits', 'total', '+')}, 9) AS high, round({V.base_rate('(hits::double / total)', '0.01::double', 100, 'NULL')}, 9) AS precision_100 FROM t")
def validation_baseline(spark, d):
    t = V.judged(spark, d, "validation").groupBy("benign_subclass", "bypass_class").agg(F.count("*").alias("total"), F.count_if(F.col("margin") > 0).alias("hits"))
    h, n = F.col("hits"), F.col("total")
    return t.select("*", F.round(M.wilson(h, n, -1), 9).alias("low"), F.round(M.wilson(h, n, 1), 9).alias("high"), F.round(M.base_rate_precision(h / n, F.lit(0.01), 100, None), 9).alias("precision_100"))


@query(f"WITH {V.TEST}, a AS (SELECT bypass_class, {V.counted('pred_attack')} FROM test GROUP BY 1), b AS (SELECT bypass_class, {V.counted('margin > threshold_tau')} FROM test GROUP BY 1) SELECT bypass_class, abs(a.tp - b.tp) + abs(a.fp - b.fp) + abs(a.fn - b.fn) + abs(a.tn - b.tn) AS difference, a.tp + a.fn + a.fp + a.tn AS total FROM a FULL OUTER JOIN b USING (bypass_class)")
def recompute_check(spark, d):
    """Counts from stored predictions against counts from scores and thresholds."""
    df = V.judged(spark, d, "test")
    a = df.groupBy("bypass_class").agg(*M.counts(_truth(), _flag()))
    b = df.groupBy("bypass_class").agg(*M.counts(_truth(), F.col("margin") > F.col("threshold_tau")))
    names = ("tp", "fp", "fn", "tn")
    b = b.select("bypass_class", *(F.col(c).alias(f"{c}2") for c in names))
    gap = sum((F.abs(F.coalesce(c, F.lit(0)) - F.coalesce(f"{c}2", F.lit(0))) for c in names[1:]), F.abs(F.coalesce("tp", F.lit(0)) - F.coalesce("tp2", F.lit(0))))
    return a.join(b, "bypass_class", "full_outer").select("bypass_class", gap.alias("difference"), sum((F.col(c) for c in names[1:]), F.col("tp")).alias("total"))


@query(f"WITH {V.VAL}, {_STEPS.format('val')}, j AS (SELECT score, round(tp::double / attacks - fp::double / benign, 12) AS gap FROM s) SELECT score AS tau, round(gap, 9) AS gap FROM j ORDER BY j.gap DESC, score DESC LIMIT 1")
def youden_tau(spark, d):
    return T.youden(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin").select("tau", F.round("gap", 9).alias("gap"))


@query(f"WITH {V.VAL}, {_STEPS.format('val')} SELECT min(score) AS tau, round(max(tp::double / attacks), 9) AS recall, round(max(fp::double / benign), 9) AS fpr, max(tp) AS tp, max(fp) AS fp FROM s WHERE fp::double / benign <= 0.01")
def recall_at_fpr(spark, d):
    return T.recall_at_fpr(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin", 0.01).select("tau", F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"), "tp", "fp")


def _grid(n: int) -> str:
    return f"q AS (SELECT unnest(list_distinct(list_concat(quantile_cont(margin, list_transform(range({n}), lambda i: i::double / {n - 1})), [min(margin) - 1e-6::double, max(margin) + 1e-6::double]))) AS tau FROM val), c AS (SELECT tau, count(*) FILTER (truth AND margin > tau) AS tp, count(*) FILTER (NOT truth AND margin > tau) AS fp, count(*) FILTER (truth) AS attacks, count(*) FILTER (NOT truth) AS benign FROM q CROSS JOIN val GROUP BY 1)"


@query(f"WITH {V.VAL}, {_grid(1001)} SELECT round(tau, 9) AS tau, tp FROM c WHERE fp = 0 ORDER BY tp DESC, c.tau LIMIT 1")
def zero_fp_grid(spark, d):
    return T.zero_fp_grid(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin").select(F.round("tau", 9).alias("tau"), "tp")


@query(f"WITH {V.VAL} SELECT coalesce(max(margin) FILTER (NOT truth), min(margin) - 1e-9::double) AS tau FROM val")
def zero_fp_max(spark, d):
    return T.zero_fp_max(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin")


_R, _P = V.ratio("tp", "attacks"), V.base_rate(V.ratio("tp", "attacks"), V.ratio("fp", "benign"), 100)


@query(f"WITH {V.VAL}, {_grid(401)}, f AS (SELECT tau, round({V.ratio(f'2 * {_P} * {_R}', f'{_P} + {_R}')}, 12) AS f1 FROM c WHERE tp >= greatest(30, ceil(attacks / 100.0))) SELECT round(max_by(tau, (f1, -tau)), 9) AS tau, round(max(f1), 9) AS f1 FROM f")
def base_rate_f1_tau(spark, d):
    return T.base_rate_f1(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin").select(F.round("tau", 9).alias("tau"), F.round("f1", 9).alias("f1"))


@query(f"WITH {V.VAL}, a AS (SELECT unnest([0.01::double, 0.1::double, 0.2::double]) AS alpha), r AS (SELECT margin, row_number() OVER (ORDER BY margin) AS rn, count(*) OVER () AS n FROM val WHERE NOT truth) SELECT alpha, margin AS tau FROM a JOIN r ON rn = least(n, ceil(round((n + 1) * (1 - alpha), 9)))")
def conformal_tau(spark, d):
    return T.order_statistic(V.judged(spark, d, "validation", "pred_attack").where(~_truth()), "margin", [0.01, 0.1, 0.2])


@query(f"WITH {V.VAL}, r AS (SELECT margin, row_number() OVER (ORDER BY margin DESC) AS rn, count(*) OVER () AS n FROM val WHERE NOT truth) SELECT round(coalesce(max(margin) FILTER (rn = floor(n * 0.05::double) + 1) + 1e-12::double, min(margin) - 1e-9::double), 12) AS tau FROM r")
def budget_tau(spark, d):
    return T.budget(V.judged(spark, d, "validation", "pred_attack"), _truth(), "margin", 0.05).select(F.round("tau", 12).alias("tau"))


_POINTS = [round(i / 50, 2) for i in range(11)]


@query(f"WITH {V.TEST}, {_STEPS.format('test')}, k AS (SELECT fp::double / benign AS x, max(tp::double / attacks) AS y, min(tp::double / attacks) AS y0 FROM s GROUP BY 1), w AS (SELECT unnest({_POINTS}::double[]) AS fpr), j AS (SELECT fpr, max_by((x, y), x) FILTER (x <= fpr) AS a, min_by((x, y0), x) FILTER (x > fpr) AS b FROM w CROSS JOIN k GROUP BY 1) SELECT fpr, round(CASE WHEN b IS NULL THEN coalesce(a[2], 0) ELSE coalesce(a[2], 0) + (b[2] - coalesce(a[2], 0)) * (fpr - coalesce(a[1], 0)) / (b[1] - coalesce(a[1], 0)) END, 9) AS recall FROM j")
def roc_points(spark, d):
    return T.roc_on_grid(V.judged(spark, d, "test", "pred_attack"), _truth(), "margin", _POINTS).select("fpr", F.round("recall", 9).alias("recall"))
