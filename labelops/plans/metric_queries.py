"""Curves, thresholds, metrics and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.functions.scores import sigmoid_array
from labelops.operators import curves, ensemble, hierarchy, metrics, thresholds
from labelops.plans.inputs import MODEL_NAMES, Inputs, joined
from labelops.plans.registry import query
from labelops.plans.shape_queries import UNION_CTE
from labelops.vocab import BINARY_CLASSES, hierarchy_edges, label_at


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _curve_ctes(keys: str, source: str = "scores", position: str = "pos") -> tuple[str, str, str]:
    """Score-ordered running counts and both curve metrics, one window per label."""
    keys = f"{keys}, {position}"
    return (
        f"steps AS (SELECT {keys}, score, sum(y) AS n_pos, sum(1 - y) AS n_neg FROM {source} GROUP BY {keys}, score)",
        f"""running AS (
          SELECT *, sum(n_pos) OVER w AS cum_pos, sum(n_neg) OVER w AS cum_neg,
                 sum(n_pos) OVER g AS pos_total, sum(n_neg) OVER g AS neg_total
          FROM steps WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                            g AS (PARTITION BY {keys}))""",
        f"""curve AS (
          SELECT {keys}, max(pos_total) AS support,
                 CASE WHEN max(pos_total) > 0 AND max(neg_total) > 0 THEN
                   sum(n_neg * (cum_pos - n_pos / 2.0::DOUBLE)) / (max(pos_total)::DOUBLE * max(neg_total)::DOUBLE) END AS roc_auc,
                 CASE WHEN max(pos_total) > 0 THEN
                   sum(n_pos * cum_pos::DOUBLE / (cum_pos + cum_neg)::DOUBLE) / max(pos_total)::DOUBLE END AS ap
          FROM running GROUP BY {keys})""",
    )


@query(
    "w6_running_counts",
    """SELECT r.model, v.label, round(r.score, 9) AS score, CAST(r.n_pos AS BIGINT) AS n_pos, CAST(r.n_neg AS BIGINT) AS n_neg,
              CAST(r.cum_pos AS BIGINT) AS cum_pos, CAST(r.cum_neg AS BIGINT) AS cum_neg
       FROM running r JOIN vocab v ON r.pos = v.pos""",
    *_curve_ctes("model")[:2],
)
def running(t: Inputs) -> DataFrame:
    steps = curves.score_steps(t.scores)
    return steps.select(
        "model", label_at("pos").alias("label"), F.round("score", 9).alias("score"), "n_pos", "n_neg", "cum_pos", "cum_neg"
    )


@query(
    "m1_roc_auc",
    "SELECT c.model, v.label, round(c.roc_auc, 9) AS roc_auc FROM curve c JOIN vocab v ON c.pos = v.pos",
    *_curve_ctes("model"),
)
def roc_auc(t: Inputs) -> DataFrame:
    per_label = curves.label_curve_metrics(t.scores)
    return rounded(per_label.select("model", label_at("pos").alias("label"), "roc_auc"), "roc_auc")


@query(
    "m2_average_precision",
    "SELECT c.model, v.label, round(c.ap, 9) AS ap FROM curve c JOIN vocab v ON c.pos = v.pos",
    *_curve_ctes("model"),
)
def average_precision(t: Inputs) -> DataFrame:
    per_label = curves.label_curve_metrics(t.scores)
    return rounded(per_label.select("model", label_at("pos").alias("label"), "ap"), "ap")


@query(
    "m1_m2_curves_of_logits",
    "SELECT k AS output, CAST(support AS BIGINT) AS support, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS ap FROM curve",
    "logit_scores AS (SELECT 0 AS grp, k, y, CAST(logit AS DOUBLE) AS score FROM logits)",
    *_curve_ctes("grp", "logit_scores", "k"),
)
def logit_curves(t: Inputs) -> DataFrame:
    scores = t.logits.select("y", F.col("embedding").cast("array<double>").alias("scores"))
    per_output = curves.label_curve_metrics(scores, groups=[])
    return rounded(per_output.withColumnRenamed("pos", "output"), "roc_auc", "ap", digits=6)


@query(
    "m3_weighted_curve_metrics",
    """SELECT model, round(sum(roc_auc * support) / sum(support), 9) AS roc_auc,
              round(sum(ap * support) / sum(support), 9) AS ap FROM curve GROUP BY model""",
    *_curve_ctes("model"),
)
def weighted(t: Inputs) -> DataFrame:
    return rounded(curves.weighted_curve_metrics(t.scores), "roc_auc", "ap")


CONFUSION = """
confusion AS (
  SELECT model, pos, label, CAST(sum(y * yhat) AS DOUBLE) AS tp, CAST(sum((1 - y) * yhat) AS DOUBLE) AS fp,
         CAST(sum(y * (1 - yhat)) AS DOUBLE) AS fn
  FROM preds_long GROUP BY ALL)
"""


@query(
    "m4_weighted_f1",
    """SELECT model, round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END * (tp + fn))
              / sum(tp + fn), 9) AS f1 FROM confusion GROUP BY model""",
    CONFUSION,
)
def weighted_f1(t: Inputs) -> DataFrame:
    return rounded(metrics.weighted_f1(t.predictions), "f1")


@query(
    "f16_label_f_beta",
    """SELECT model, label, b.beta, round(p, 9) AS precision, round(r, 9) AS recall,
              round(CASE WHEN b.beta * b.beta * p + r <> 0 THEN (1 + b.beta * b.beta) * p * r / (b.beta * b.beta * p + r) END, 9) AS f_beta
       FROM (SELECT model, label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM confusion)
       CROSS JOIN (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) AS b(beta)""",
    CONFUSION,
)
def f_beta(t: Inputs) -> DataFrame:
    tables = [
        metrics.label_f_beta(t.predictions, beta).withColumn("beta", F.lit(beta)) for beta in (1.0, 2.0)
    ]
    both = tables[0].unionByName(tables[1]).withColumn("label", label_at("pos")).drop("pos")
    return rounded(both, "precision", "recall", "f_beta")


@query(
    "m5_subset_accuracy",
    """SELECT model, round(avg(hit), 9) AS accuracy FROM (
         SELECT model, id, CAST(min(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS DOUBLE) AS hit FROM preds_long GROUP BY ALL)
       GROUP BY model""",
)
def accuracy(t: Inputs) -> DataFrame:
    return rounded(metrics.subset_accuracy(t.predictions), "accuracy")


SWEEP = (
    """cuts AS (
      SELECT s.model, s.pos, s.label, g.cut, g.threshold,
             CAST(sum(CASE WHEN s.score >= g.threshold THEN s.y ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN s.score >= g.threshold THEN 1 - s.y ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(s.y) AS DOUBLE) AS p, CAST(sum(1 - s.y) AS DOUBLE) AS q
      FROM scores s CROSS JOIN grid g GROUP BY ALL)""",
    """f1s AS (
      SELECT model, cut, threshold,
             sum(CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END * p) / sum(p) AS f1
      FROM cuts GROUP BY ALL)""",
    """accuracies AS (
      SELECT model, cut, avg(CAST(hit AS DOUBLE)) AS accuracy FROM (
        SELECT s.model, g.cut, s.id, min(CASE WHEN (s.score >= g.threshold) = (s.y = 1) THEN 1 ELSE 0 END) AS hit
        FROM scores s CROSS JOIN grid g GROUP BY ALL) GROUP BY ALL)""",
)


@query(
    "m6_threshold_sweep",
    """SELECT f.model, f.cut, round(f.threshold, 6) AS threshold, round(f.f1, 9) AS f1, round(a.accuracy, 9) AS accuracy
       FROM (SELECT model, CAST(cut AS INTEGER) AS cut, threshold, f1 FROM f1s) f
       JOIN accuracies a ON f.model = a.model AND f.cut = a.cut""",
    *SWEEP,
)
def sweep(t: Inputs) -> DataFrame:
    table = rounded(thresholds.threshold_sweep(t.scores), "f1", "accuracy")
    return rounded(table, "threshold", digits=6)


@query(
    "w4_sweep_maxima",
    """SELECT f.model, round(max(f.f1), 9) AS max_f1, round(max(a.accuracy), 9) AS max_accuracy
       FROM f1s f JOIN accuracies a ON f.model = a.model AND f.cut = a.cut GROUP BY f.model""",
    *SWEEP,
)
def maxima(t: Inputs) -> DataFrame:
    return rounded(thresholds.sweep_maxima(t.scores), "max_f1", "max_accuracy")


LABEL_SWEEP = (
    SWEEP[0],
    """both_classes AS (
      SELECT model, pos, label, cut, threshold,
             (p * CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END
              + q * CASE WHEN 2 * (q - fp) + (p - tp) + fp > 0 THEN 2 * (q - fp) / (2 * (q - fp) + (p - tp) + fp) ELSE 0 END)
             / (p + q) AS f1
      FROM cuts)""",
    """best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY f1 DESC, cut) AS r FROM both_classes)
      WHERE r = 1)""",
)


@query(
    "m7_label_thresholds",
    "SELECT model, label, round(threshold, 6) AS threshold, round(f1, 9) AS f1 FROM best",
    *LABEL_SWEEP,
)
def label_thresholds(t: Inputs) -> DataFrame:
    return rounded(rounded(thresholds.best_label_thresholds(t.scores), "f1"), "threshold", digits=6)


@query(
    "w3_first_best_threshold",
    """SELECT model, CAST(cut AS INTEGER) AS cut, round(f1, 9) AS f1 FROM (
         SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(f1, 9) DESC, cut) AS r FROM f1s) WHERE r = 1""",
    *SWEEP[:2],
)
def first_best(t: Inputs) -> DataFrame:
    return thresholds.first_best_cut(rounded(thresholds.sweep_f1(t.scores), "f1")).select("model", "cut", "f1")


@query(
    "f17_threshold_grid",
    """SELECT model, CAST(cut AS INTEGER) AS cut, round(threshold, 6) AS threshold, CAST(sum(tp + fp) AS BIGINT) AS n_reached
       FROM cuts GROUP BY ALL""",
    SWEEP[0],
)
def grid(t: Inputs) -> DataFrame:
    counts = thresholds.grid_counts(t.scores).groupBy("model", "cut", "threshold")
    return rounded(counts.agg(F.sum(F.col("tp") + F.col("fp")).alias("n_reached")), "threshold", digits=6)


@query(
    "f14_sigmoid",
    "SELECT id, k, round(1 / (1 + exp(-CAST(logit AS DOUBLE))), 9) AS probability FROM logits",
)
def sigmoids(t: Inputs) -> DataFrame:
    probabilities = t.logits.select("id", F.posexplode(sigmoid_array("embedding")).alias("k", "probability"))
    return rounded(probabilities, "probability")


# --- hierarchical metrics; node sets per (id, group)

def _hierarchical_cte(keys: str, source: str, flag: str = "yhat") -> tuple[str, str]:
    """Gold and predicted nodes per row, then sums per group."""
    return (
        f"""cells AS (
          SELECT p.id, {keys}, c.node, max(p.y) AS g, max(p.{flag}) AS h
          FROM {source} p JOIN closure c ON p.label = c.label GROUP BY ALL)""",
        f"""h_counts AS (
          SELECT {keys}, CAST(sum(g * h) AS BIGINT) AS tp, CAST(sum(h) AS BIGINT) AS n_pred, CAST(sum(g) AS BIGINT) AS n_gold
          FROM cells GROUP BY ALL)""",
    )


def _hierarchical_select(keys: str) -> str:
    return f"""SELECT {keys}, tp, n_pred, n_gold,
      round(CASE WHEN tp > 0 THEN 2 * (tp / n_pred::DOUBLE) * (tp / n_gold::DOUBLE) / (tp / n_pred::DOUBLE + tp / n_gold::DOUBLE) END, 9) AS f1_h,
      round(CASE WHEN n_pred > 0 THEN tp / n_pred::DOUBLE END, 9) AS prec_h,
      round(CASE WHEN n_gold > 0 THEN tp / n_gold::DOUBLE END, 9) AS rec_h FROM h_counts"""


def _rounded_scores(df: DataFrame) -> DataFrame:
    return rounded(df, "f1_h", "prec_h", "rec_h")


UNION_LONG = """
union_long AS (
  SELECT id, lang, data_type, label, max(y) AS y, max(yhat) AS yhat, 'union' AS ensemble FROM preds_long GROUP BY ALL)
"""


@query(
    "m8_hierarchical_scores",
    _hierarchical_select("ensemble"),
    UNION_LONG,
    *_hierarchical_cte("ensemble", "union_long"),
)
def hierarchical(t: Inputs) -> DataFrame:
    """Union ensemble of all models against gold: the main query."""
    predictions = ensemble.ensemble_by_union(t.predictions)
    scores = metrics.hierarchical_scores(metrics.align(t.gold, predictions))
    return _rounded_scores(scores.withColumn("ensemble", F.lit("union")))


@query(
    "m8_scores_from_edges",
    _hierarchical_select("ensemble"),
    UNION_LONG,
    *_hierarchical_cte("ensemble", "union_long"),
)
def hierarchical_from_edges(t: Inputs) -> DataFrame:
    """The main query with the hierarchy read as a table of edges."""
    masks = hierarchy.node_words(hierarchy.ancestor_table(hierarchy_edges(t.spark)))
    aligned = metrics.align(t.gold, ensemble.ensemble_by_union(t.predictions))
    return _rounded_scores(metrics.hierarchical_scores(aligned, masks=masks).withColumn("ensemble", F.lit("union")))


@query(
    "m9_hierarchical_report",
    _hierarchical_select("model, train_set, lang"),
    *_hierarchical_cte("model, train_set, lang", "preds_long"),
)
def report(t: Inputs) -> DataFrame:
    aligned = metrics.align(t.gold, t.predictions.select("id", "model", "train_set", "labels", "lang"), run=["model"], n_runs=6)
    return _rounded_scores(metrics.hierarchical_scores(aligned, ["model", "train_set", "lang"]))


VOTE_LONG = """
votes AS (SELECT id, train_set, label, max(y) AS y, sum(yhat) AS n FROM preds_long GROUP BY ALL),
ensembles AS (
  SELECT id, train_set, 'union' AS ensemble, label, y, CASE WHEN n >= 1 THEN 1 ELSE 0 END AS yhat FROM votes
  UNION ALL
  SELECT id, train_set, 'vote', label, y, CASE WHEN n >= 1.5 THEN 1 ELSE 0 END FROM votes)
"""


@query(
    "m9_ensemble_report",
    _hierarchical_select("train_set, ensemble"),
    VOTE_LONG,
    *_hierarchical_cte("train_set, ensemble", "ensembles"),
)
def ensemble_report(t: Inputs) -> DataFrame:
    both = ensemble.both_ensembles(t.predictions, n_models=3, keys=["id", "train_set"])
    aligned = metrics.align(t.gold, both, run=["train_set", "ensemble"], n_runs=4)
    return _rounded_scores(metrics.hierarchical_scores(aligned, ["train_set", "ensemble"]))


@query(
    "a11_ensemble_by_union",
    "SELECT id, labels FROM union_preds",
    UNION_CTE,
)
def by_union(t: Inputs) -> DataFrame:
    return joined(ensemble.ensemble_by_union(t.predictions))


@query(
    "a12_ensemble_by_vote",
    """SELECT id, coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE n >= 3), '') AS labels
       FROM (SELECT id, label, sum(yhat) AS n FROM preds_long GROUP BY ALL) GROUP BY id""",
)
def by_vote(t: Inputs) -> DataFrame:
    return joined(ensemble.ensemble_by_vote(t.predictions, n_models=len(MODEL_NAMES)))


@query(
    "m10_binary_scores",
    """SELECT round((f_pos + f_neg) / 2, 9) AS macro_f1,
              round(CAST(2 * (tp + tn) AS DOUBLE) / (2 * (tp + tn) + 2 * (fp + fn)), 9) AS micro_f1
       FROM (SELECT *, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f_pos,
                       coalesce(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fp + fn, 0), 0) AS f_neg
             FROM (SELECT sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS tp,
                          sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) AS fp,
                          sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS fn,
                          sum(CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END) AS tn FROM annotations))""",
)
def binary(t: Inputs) -> DataFrame:
    negative, positive = BINARY_CLASSES
    rows = t.annotations.select(
        F.when(F.col("toxic") == 1, positive).otherwise(negative).alias("gold"),
        F.when(F.col("quality") == 0, positive).otherwise(negative).alias("predicted"),
    )
    return rounded(metrics.binary_scores(rows, BINARY_CLASSES), "macro_f1", "micro_f1")


@query(
    "m11_cross_entropy",
    """SELECT model, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss
       FROM (SELECT model, y, least(greatest(score, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p FROM scores) GROUP BY model""",
)
def loss(t: Inputs) -> DataFrame:
    return rounded(metrics.mean_cross_entropy(t.scores), "loss", digits=6)


RUN_CURVE = _curve_ctes("model, train_set, data_type")


@query(
    "m12_label_metric_table",
    """SELECT c.model, c.train_set, c.data_type, v.label, round(c.roc_auc, 9) AS roc_auc, round(c.ap, 9) AS ap,
              CAST(c.support AS BIGINT) AS support, v.display_rank
       FROM curve c JOIN vocab v ON c.pos = v.pos""",
    *RUN_CURVE,
)
def metric_table(t: Inputs) -> DataFrame:
    table = curves.label_metric_table(t.scores, ["model", "train_set", "data_type"])
    return rounded(table, "roc_auc", "ap").orderBy("model", "train_set", "data_type", "display_rank")


@query(
    "p12_melt_metric_table",
    """SELECT c.model, v.label, 'roc_auc' AS variable, round(c.roc_auc, 9) AS value FROM curve c JOIN vocab v ON c.pos = v.pos
       UNION ALL SELECT c.model, v.label, 'ap', round(c.ap, 9) FROM curve c JOIN vocab v ON c.pos = v.pos""",
    *_curve_ctes("model"),
)
def melted(t: Inputs) -> DataFrame:
    table = curves.label_curve_metrics(t.scores).withColumn("label", label_at("pos"))
    return rounded(curves.melted_metric_table(table), "value")


@query(
    "w5_best_run_by_ap",
    """SELECT data_type, model, round(ap, 9) AS ap FROM (
         SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY ap DESC) AS r FROM (
           SELECT data_type, model, sum(ap * support) / sum(support) AS ap FROM curve GROUP BY ALL)) WHERE r = 1""",
    *RUN_CURVE,
)
def best_run(t: Inputs) -> DataFrame:
    runs = curves.weighted_curve_metrics(t.scores, ["data_type", "model"])
    best = metrics.best_run(runs, "ap", ["data_type"])
    return rounded(best.select("data_type", "model", "ap"), "ap")


@query(
    "m13_majority_baseline",
    _hierarchical_select("baseline"),
    """top AS (SELECT label FROM gold_long GROUP BY label, pos ORDER BY sum(y) DESC, pos LIMIT 1)""",
    """majority AS (
      SELECT g.id, g.label, g.y, CASE WHEN g.label = t.label THEN 1 ELSE 0 END AS yhat, t.label AS baseline
      FROM gold_long g CROSS JOIN top t)""",
    *_hierarchical_cte("baseline", "majority"),
)
def majority(t: Inputs) -> DataFrame:
    baseline = metrics.majority_predictions(t.gold)
    aligned = metrics.align(t.gold, baseline).withColumn("baseline", F.col("predicted")[0])
    return _rounded_scores(metrics.hierarchical_scores(aligned, ["baseline"]))
