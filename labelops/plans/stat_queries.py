"""Label statistics and report order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.functions import text as T
from labelops.operators import reshape, stats
from labelops.plans.inputs import SPLITS, Inputs, sql_text
from labelops.plans.registry import query
from labelops.plans.text_queries import sql_linebreaks
from labelops.vocab import LABELS

SPLIT_COLUMNS = ", ".join(
    f"CAST(sum(CASE WHEN data_type = '{s}' THEN y ELSE 0 END) AS BIGINT) AS \"{s}\"" for s in SPLITS
)


@query("a1_label_support", "SELECT label, CAST(sum(y) AS BIGINT) AS n FROM gold_long GROUP BY label")
def support(t: Inputs) -> DataFrame:
    return stats.label_support(t.gold).select("label", "n")


@query(
    "a1_support_of_wide_table",
    "SELECT "
    + ", ".join(f'CAST(sum(CASE WHEN label = {sql_text(v)} THEN y END) AS BIGINT) AS "{v}"' for v in LABELS)
    + " FROM gold_long",
)
def support_wide(t: Inputs) -> DataFrame:
    return stats.support_wide(reshape.one_hot_encode(t.gold.select("id", "labels")))


@query("a2_labels_per_split", "SELECT data_type, CAST(sum(y) AS BIGINT) AS total FROM gold_long GROUP BY data_type")
def per_split(t: Inputs) -> DataFrame:
    return stats.labels_per_split(t.gold)


@query(
    "a3_split_label_counts",
    "SELECT data_type, label, count(*) AS n FROM gold_long WHERE y = 1 GROUP BY ALL",
)
def split_counts(t: Inputs) -> DataFrame:
    return stats.split_label_counts(t.gold)


@query(
    "a4_split_share",
    """SELECT data_type, label, count(*) AS n,
              round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY data_type) AS DOUBLE), 9) AS share,
              round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY data_type) AS DOUBLE) * 100, 6) AS percent
       FROM gold_long WHERE y = 1 GROUP BY data_type, label""",
)
def split_share(t: Inputs) -> DataFrame:
    shares = stats.with_split_share(stats.split_label_counts(t.gold))
    return shares.withColumn("share", F.round("share", 9)).withColumn("percent", F.round("percent", 6))


@query("a5_compare_splits", f"SELECT label, {SPLIT_COLUMNS} FROM gold_long GROUP BY label")
def compare(t: Inputs) -> DataFrame:
    return stats.compare_supports(t.gold, "data_type", SPLITS).drop("pos")


@query(
    "a6_total_row",
    f"SELECT label, {SPLIT_COLUMNS} FROM gold_long GROUP BY label UNION ALL SELECT 'Total', {SPLIT_COLUMNS} FROM gold_long",
)
def total_row(t: Inputs) -> DataFrame:
    return stats.with_total_row(stats.compare_supports(t.gold, "data_type", SPLITS), SPLITS)


@query(
    "a7_split_sizes",
    """SELECT data_type, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 0) AS percent
       FROM docs GROUP BY data_type""",
)
def sizes(t: Inputs) -> DataFrame:
    return stats.split_sizes(t.gold)


@query(
    "a8_length_boxes",
    """SELECT q.label, q.n_rows, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
              min(m.word_count) AS whisker_low, max(m.word_count) AS whisker_high
       FROM quartiles q JOIN measured m ON q.label = m.label
       WHERE m.word_count BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)
       GROUP BY ALL""",
    f"""measured AS (
      SELECT g.label, CAST(len(list_filter(string_split({sql_linebreaks('d.text')}, ' '), lambda w: w <> '')) AS INTEGER) AS word_count
      FROM docs d JOIN gold_long g ON d.id = g.id WHERE g.y = 1)""",
    """quartiles AS (
      SELECT label, count(*) AS n_rows, quantile_cont(CAST(word_count AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST(word_count AS DOUBLE), 0.5) AS median, quantile_cont(CAST(word_count AS DOUBLE), 0.75) AS q3
      FROM measured GROUP BY label)""",
)
def boxes(t: Inputs) -> DataFrame:
    counted = t.gold.select("labels", T.word_count(T.remove_linebreaks("text")).alias("word_count"))
    measured = counted.select("word_count", F.explode("labels").alias("label"))
    rounded = {c: F.round(c, 6) for c in ("q1", "median", "q3")}
    return stats.length_boxes(measured).withColumns(rounded)


CORRELATION = """
  SELECT a.label AS label_a, b.label AS label_b,
         CASE WHEN min(a.y) = max(a.y) OR min(b.y) = max(b.y) THEN NULL ELSE
           round((count(*) * CAST(sum(a.y * b.y) AS DOUBLE) - CAST(sum(a.y) AS DOUBLE) * sum(b.y))
             / sqrt(CAST(sum(a.y) AS DOUBLE) * (count(*) - sum(a.y)) * CAST(sum(b.y) AS DOUBLE) * (count(*) - sum(b.y))), 9)
         END AS pearson
  FROM gold_long a JOIN gold_long b ON a.id = b.id {condition}
  GROUP BY a.label, b.label"""


@query("a9_label_correlation", CORRELATION.format(condition=""))
def correlation(t: Inputs) -> DataFrame:
    return stats.label_correlation(t.gold).withColumn("pearson", F.round("pearson", 9))


@query("a10_lower_triangle", CORRELATION.format(condition="AND a.pos > b.pos"))
def triangle(t: Inputs) -> DataFrame:
    return stats.label_correlation(t.gold, lower_only=True).withColumn("pearson", F.round("pearson", 9))


@query(
    "a13_label_links",
    """SELECT p.model, g.label AS gold, p.label AS predicted, count(*) AS n
       FROM gold_long g JOIN preds_long p ON g.id = p.id
       WHERE g.y = 1 AND p.yhat = 1 GROUP BY ALL""",
)
def links(t: Inputs) -> DataFrame:
    return stats.label_links(t.gold, t.predictions, ["model"])


@query(
    "a14_label_nodes",
    "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS node FROM gold_long WHERE y = 1 GROUP BY label",
)
def nodes(t: Inputs) -> DataFrame:
    return stats.label_nodes(t.gold)


@query(
    "w1_order_by_train_percent",
    """SELECT label, round(count(*) * CAST(100 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS percent,
              CAST(row_number() OVER (ORDER BY count(*) DESC, pos) AS INTEGER) AS rank
       FROM gold_long WHERE data_type = 'Train' AND y = 1 GROUP BY label, pos""",
)
def order_by_percent(t: Inputs) -> DataFrame:
    train = stats.label_support(t.gold.filter(F.col("data_type") == "Train"), ["data_type"]).filter("n > 0")
    ranked = stats.rank_labels(stats.with_split_share(train))
    return ranked.select("label", F.round("percent", 6).alias("percent"), "rank").orderBy("rank")


@query(
    "w2_order_by_support",
    """SELECT label, CAST(sum(y) AS BIGINT) AS n,
              CAST(row_number() OVER (ORDER BY sum(y), pos) AS INTEGER) AS rank_ascending,
              CAST(row_number() OVER (ORDER BY sum(y) DESC, pos) AS INTEGER) AS rank_descending
       FROM gold_long GROUP BY label, pos""",
)
def order_by_support(t: Inputs) -> DataFrame:
    counts = stats.label_support(t.gold)
    ascending = stats.rank_labels(counts, ascending=True).withColumnRenamed("rank", "rank_ascending")
    both = stats.rank_labels(ascending).withColumnRenamed("rank", "rank_descending")
    return both.drop("pos").orderBy("rank_ascending")
