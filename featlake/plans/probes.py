"""Queries on probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import probes as P
from featlake.operators import recovery as R
from featlake.plans.registry import query
from featlake.sources import views as V
from featlake.sources.files import stage

BASE = f"""WITH {V.ACTS}, {V.SPLIT}, tr AS (SELECT * FROM split WHERE split = 'train'), te AS (SELECT * FROM split WHERE split = 'test'),
c AS (SELECT DISTINCT t.label AS category, a.feature, a.value FROM acts a JOIN tr t ON t.row_id = a.row_id),
pos AS (SELECT label AS category, count(*) AS positives FROM tr GROUP BY label),
tot AS (SELECT feature, value, sum(n) OVER (PARTITION BY feature ORDER BY value DESC) AS predicted FROM (SELECT a.feature, a.value, count(*) AS n FROM acts a JOIN tr ON tr.row_id = a.row_id GROUP BY a.feature, a.value)),
hit AS (SELECT category, feature, value, sum(n) OVER (PARTITION BY category, feature ORDER BY value DESC) AS tp FROM (SELECT t.label AS category, a.feature, a.value, count(*) AS n FROM acts a JOIN tr t ON t.row_id = a.row_id GROUP BY t.label, a.feature, a.value)),
cur AS (SELECT h.category, h.feature, h.value AS threshold, CAST(h.tp AS BIGINT) AS tp, CAST(tot.predicted - h.tp AS BIGINT) AS fp, CAST(pos.positives - h.tp AS BIGINT) AS fn, 2.0::DOUBLE * h.tp / (tot.predicted + pos.positives) AS f1 FROM hit h JOIN tot USING (feature, value) JOIN pos USING (category)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, tp DESC, fp, feature, threshold DESC) AS r FROM cur) WHERE r = 1)"""
EVAL = BASE + """, fired AS (SELECT b.category, a.row_id FROM best b JOIN acts a ON a.feature = b.feature AND a.value >= b.threshold JOIN te ON te.row_id = a.row_id),
ev AS (SELECT b.category, b.feature, count(te.row_id) FILTER (f.row_id IS NOT NULL AND te.label = b.category) AS tp, count(te.row_id) FILTER (f.row_id IS NOT NULL AND te.label <> b.category) AS fp,
 count(te.row_id) FILTER (f.row_id IS NULL AND te.label = b.category) AS fn, count(te.row_id) FILTER (f.row_id IS NULL AND te.label <> b.category) AS tn FROM best b CROSS JOIN te LEFT JOIN fired f ON f.category = b.category AND f.row_id = te.row_id GROUP BY b.category, b.feature)"""


def _parts(spark, d):
    split = V.split(spark, d)
    member = split.select("row_id", F.col("label").alias("category"))
    return V.acts(spark, d), member, split.filter("split = 'train'").select("row_id"), split.filter("split = 'test'").select("row_id")


def _best(spark, d):
    acts, member, train, _ = _parts(spark, d)
    return P.select(acts, member, train)


@query("L18_probe_select", BASE + " SELECT category, feature, round(CAST(threshold AS DOUBLE), 6) AS threshold, tp, fp, fn, round(f1, 6) AS f1 FROM best")
def select(spark, d):
    return _best(spark, d).select("category", "feature", F.round(F.col("threshold").cast("double"), 6).alias("threshold"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("L19_probe_evaluate", EVAL + " SELECT category, feature, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM ev")
def evaluate(spark, d):
    acts, member, _, test = _parts(spark, d)
    return P.evaluate(_best(spark, d), acts, member, test).select("category", "feature", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("G01_cumulative_curve", BASE + " SELECT category, feature, round(CAST(threshold AS DOUBLE), 6) AS threshold, tp, CAST(tp + fp AS BIGINT) AS predicted FROM cur WHERE category = 3 AND feature < 4")
def curve(spark, d):
    acts, member, train, _ = _parts(spark, d)
    return P.curves(acts.filter("feature < 4"), member, train).filter("category = 3").select("category", "feature", F.round(F.col("threshold").cast("double"), 6).alias("threshold"), "tp", "predicted")


@query("G02_best_per_feature", BASE + " SELECT category, feature, round(f1, 6) AS f1, round(CAST(threshold AS DOUBLE), 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY category, feature ORDER BY f1 DESC, threshold DESC) AS q FROM cur) WHERE q = 1")
def per_feature(spark, d):
    from pyspark.sql import Window

    acts, member, train, _ = _parts(spark, d)
    c = P.curves(acts, member, train).withColumn("f1", 2.0 * F.col("tp") / (F.col("predicted") + F.col("positives")))
    w = Window.partitionBy("category", "feature").orderBy(F.desc("f1"), F.desc("threshold"))
    return c.withColumn("q", F.row_number().over(w)).filter("q = 1").select("category", "feature", F.round("f1", 6).alias("f1"), F.round(F.col("threshold").cast("double"), 6).alias("threshold"))


@query("C11_exact_cutoff", EVAL + " SELECT category, CAST(2 * tp * 5 >= 1 * (2 * tp + fp + fn) AS INTEGER) AS reaches, CAST(2 * tp * 5 > 1 * (2 * tp + fp + fn) AS INTEGER) AS exceeds FROM ev")
def cutoff(spark, d):
    acts, member, _, test = _parts(spark, d)
    e = P.evaluate(_best(spark, d), acts, member, test)
    t = [F.col(c) for c in ("tp", "fp", "fn")]
    return e.select("category", P.passes(*t, 1, 5).cast("int").alias("reaches"), P.passes(*t, 1, 5, True).cast("int").alias("exceeds"))


@query("G08_stratified_split", f"WITH {V.SPLIT} SELECT row_id, label, split FROM split")
def split(spark, d):
    return V.split(spark, d).select("row_id", "label", "split")


@query("C01_split_masks", f"WITH {V.SPLIT} SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM split GROUP BY label")
def masks(spark, d):
    s = V.split(spark, d)
    P.check_split(s)
    return s.groupBy("label").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


@query("F14_confusion", "SELECT lang, tp, fp, fn, round(tp / greatest(1, tp + fp), 6) AS precision FROM (SELECT d.lang, count(*) FILTER (d.n_chars > 1500 AND l.quality = 1) AS tp, count(*) FILTER (d.n_chars > 1500 AND l.quality = 0) AS fp, count(*) FILTER (d.n_chars <= 1500 AND l.quality = 1) AS fn FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang)")
def confusion(spark, d):
    j = V.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(V.table(spark, d, "labels"), "doc_id")
    said, is_ = F.col("n_chars") > 1500, F.col("quality") == 1
    c = j.groupBy("lang").agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn"))
    return c.withColumn("precision", F.round(P.safe_ratio(F.col("tp") * 1.0, F.col("tp") + F.col("fp")), 6))


#: F1 of every label and feature at each threshold, on the rows for training; the best of each, and the best feature.
CHOSEN = f"""WITH {V.ACTS}, {V.SPLIT}, t AS (SELECT unnest(range(16)) AS h, unnest([{', '.join(map(str, R.ACTIVATION_THRESHOLDS))}]) AS threshold), a AS (SELECT acts.*, split.label, split.split FROM acts JOIN split USING (row_id)),
fired AS (SELECT a.*, t.h FROM a JOIN t ON a.value > CAST(t.threshold AS FLOAT)), pp AS (SELECT split, feature, h, count(*) AS pp FROM fired GROUP BY ALL), tp AS (SELECT split, label AS target, feature, h, count(*) AS tp FROM fired GROUP BY ALL), pos AS (SELECT split, label AS target, count(*) AS pos FROM split GROUP BY ALL),
f AS (SELECT pos.split, pos.target, pp.feature, pp.h, 2.0::DOUBLE * coalesce(tp, 0) / greatest(1, pos + pp) AS f1 FROM pos JOIN pp USING (split) LEFT JOIN tp ON tp.split = pos.split AND tp.target = pos.target AND tp.feature = pp.feature AND tp.h = pp.h),
best AS (SELECT target, feature, h, f1 FROM f WHERE split = 'train' AND f1 > 0 QUALIFY row_number() OVER (PARTITION BY target, feature ORDER BY f1 DESC, h) = 1), neuron AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY target ORDER BY f1 DESC, feature) = 1)"""


def _selected(spark, d):
    acts, s = V.acts(spark, d), V.split(spark, d)
    member = s.select("row_id", F.col("label").alias("target"), "split")
    inside = lambda k: (acts.join(s.filter(F.col("split") == k).select("row_id"), "row_id", "left_semi"), member.filter(F.col("split") == k).drop("split"))
    return inside("train"), inside("test")


@query("L21_activation_recovery", CHOSEN + " SELECT n.target, n.feature, CAST(t.threshold AS DOUBLE) AS threshold, round(n.f1, 6) AS f1, round(coalesce(f.f1, 0), 6) AS test_f1 FROM neuron n JOIN t USING (h) LEFT JOIN f ON f.split = 'test' AND f.target = n.target AND f.feature = n.feature AND f.h = n.h")
def recovery(spark, d):
    """Sixteen thresholds on one half of the rows, the chosen pairs on the other."""
    train, test = _selected(spark, d)
    chosen = R.best_neurons(R.select_activations(*train), train[1])
    out = R.evaluate_pairs(chosen, *test)
    return out.select("target", "feature", R.threshold_of(F.col("h")).alias("threshold"), F.round("f1", 6).alias("f1"), F.round("test_f1", 6).alias("test_f1"))


@query("L21_distinct_recovery")
def distinct_recovery(spark, d):
    """A feature of its own for as many labels as can have one at each goal, and its F1 on the other half."""
    train, test = _selected(spark, d)
    selected = stage(R.select_activations(*train), "selected")
    parts = [R.evaluate_pairs(R.distinct_neurons(selected, g), *test).select(F.lit(g).alias("goal"), "target", "f1", "test_f1") for g in (0.18, 0.2)]
    return parts[0].unionAll(parts[1]).groupBy("goal").agg(F.count("*").alias("matched"), F.round(F.min("f1"), 6).alias("least_f1"))
