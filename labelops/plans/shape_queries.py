"""Reshaping, joins, set operations and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.operators import ensemble, hierarchy, metrics, reshape, stats, validate
from labelops.operators.thresholds import apply_threshold
from labelops.plans.inputs import MODEL_NAMES, Inputs, joined, sql_text
from labelops.plans.registry import query
from labelops.plans.text_queries import clean_ctes
from labelops.vocab import LABELS, hierarchy_edges, label_at

WIDE = ", ".join(
    f'CAST(max(CASE WHEN label = {sql_text(v)} THEN y END) AS INTEGER) AS "{v}"' for v in LABELS
)
WIDE_CTE = f"wide AS (SELECT id, lang, {WIDE} FROM gold_long GROUP BY ALL)"


def union_gold_predictions(t: Inputs) -> DataFrame:
    return ensemble.ensemble_by_union(t.predictions)


UNION_CTE = """
union_votes AS (SELECT id, lang, data_type, label, max(yhat) AS yhat FROM preds_long GROUP BY ALL),
union_preds AS (
  SELECT id, coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE yhat = 1), '') AS labels
  FROM union_votes GROUP BY id)
"""


# --- projections, filters, reshaping

@query("p1_one_hot_encode", "SELECT * EXCLUDE (lang) FROM wide", WIDE_CTE)
def one_hot(t: Inputs) -> DataFrame:
    return reshape.one_hot_encode(t.gold.select("id", "labels"))


@query("p2_decode_labels", "SELECT id, labels FROM gold")
def decode(t: Inputs) -> DataFrame:
    wide = reshape.one_hot_encode(t.gold.select("id", "labels"))
    decoded = reshape.decode_wide(wide)
    return decoded.select("id", F.array_join("labels", "|").alias("labels"))


@query("p2_decode_indicator_rows", "SELECT id, model, labels FROM preds")
def decode_rows(t: Inputs) -> DataFrame:
    return t.predictions.select("id", "model", F.array_join(L.decode_array("yhat"), "|").alias("labels"))


@query(
    "p3_label_vector",
    "SELECT id, string_agg(CAST(CAST(y AS FLOAT) AS VARCHAR), ',' ORDER BY pos) AS vector FROM gold_long GROUP BY id",
)
def vector(t: Inputs) -> DataFrame:
    wide = reshape.one_hot_encode(t.gold.select("id", "labels"))
    return wide.select("id", F.array_join(reshape.label_vector().cast("array<string>"), ",").alias("vector"))


@query(
    "p4_model_input",
    """SELECT c.id, c.processed_text AS text, CAST(sum(y) AS DOUBLE) AS n_labels
       FROM clean c JOIN gold_long g ON c.id = g.id GROUP BY ALL""",
    clean_ctes(source="docs"),
)
def model_input(t: Inputs) -> DataFrame:
    wide = reshape.one_hot_encode(t.prepared)
    pruned = reshape.model_input(wide)
    total = F.aggregate("labels", F.lit(0.0), lambda a, x: a + x)
    return pruned.select("id", "text", total.alias("n_labels"))


@query("p5_rename_columns", "SELECT id, text AS sentence, source AS link FROM docs")
def rename(t: Inputs) -> DataFrame:
    return t.gold.select("id", "text", "source").withColumnsRenamed({"text": "sentence", "source": "link"})


@query("p6_tag_splits", "SELECT id, data_type FROM docs")
def tag(t: Inputs) -> DataFrame:
    day = F.col("doc_id") % 10
    rules = {"Validation": day == 0, "Development": day.isin(1, 2), "Train": day > 2}
    return reshape.tag_by_condition(t.gold.select("id", "doc_id"), rules).drop("doc_id")


@query(
    "p7_fill_missing",
    """SELECT d.id, coalesce(a.quality, 0) AS quality, coalesce(a.toxic, 0) AS toxic
       FROM docs d LEFT JOIN annotations a ON d.id = a.id""",
)
def fill(t: Inputs) -> DataFrame:
    return reshape.fill_missing(t.gold.select("id").join(t.annotations, "id", "left"), 0)


@query("p8_cast_like", "SELECT doc_id, quality, toxic FROM labels")
def cast(t: Inputs) -> DataFrame:
    table = t.table("labels")
    texts = table.select(*[F.col(c).cast("string").alias(c) for c in reversed(table.columns)])
    return reshape.cast_like(texts, table)


@query(
    "p10_rows_with_label",
    "SELECT d.id, d.text FROM docs d JOIN gold_long g ON d.id = g.id WHERE g.label = 'Smears' AND g.y = 1",
)
def rows_with_label(t: Inputs) -> DataFrame:
    return reshape.with_label(t.gold, "Smears").select("id", "text")


@query("p11_melt_labels", "SELECT id, label, y AS value FROM gold_long WHERE y <> 0")
def melt(t: Inputs) -> DataFrame:
    return reshape.melt_labels(reshape.one_hot_encode(t.gold.select("id", "labels")), ["id"])


@query(
    "p13_explode_labels",
    """SELECT g.id, l.label FROM gold g
       LEFT JOIN (SELECT id, label FROM gold_long WHERE y = 1) l ON g.id = l.id""",
)
def explode(t: Inputs) -> DataFrame:
    return reshape.explode_labels(t.gold.select("id", "labels"))


@query("p14_select_label_columns", "SELECT * EXCLUDE (id, lang) FROM wide", WIDE_CTE)
def label_columns(t: Inputs) -> DataFrame:
    return reshape.select_labels(reshape.one_hot_encode(t.gold.select("id", "labels")))


# --- joins

@query(
    "j1_gold_with_predictions",
    """SELECT p.id, p.model, g.labels AS gold, p.labels AS predicted
       FROM gold g JOIN preds p ON g.id = p.id""",
)
def gold_with_predictions(t: Inputs) -> DataFrame:
    both = metrics.align(t.gold, t.predictions.select("id", "model", "labels"), run=["model"], n_runs=len(MODEL_NAMES))
    return both.select("id", "model", L.joined("gold").alias("gold"), L.joined("predicted").alias("predicted"))


@query("j2_join_encoded", "SELECT * FROM wide", WIDE_CTE)
def join_encoded(t: Inputs) -> DataFrame:
    encoded = reshape.one_hot_encode(t.gold.select("id", "labels"))
    return reshape.join_encoded(t.gold.select("id", "lang"), encoded)


@query(
    "j3_align_by_id",
    "SELECT g.id, g.labels AS gold, u.labels AS predicted FROM gold g JOIN union_preds u ON g.id = u.id",
    UNION_CTE,
)
def align_by_id(t: Inputs) -> DataFrame:
    predictions = union_gold_predictions(t)
    validate.require_same_ids(t.gold, predictions)
    return metrics.align(t.gold, predictions).select(
        "id", L.joined("gold").alias("gold"), L.joined("predicted").alias("predicted")
    )


@query(
    "j4_align_models",
    "SELECT id, "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN labels END) AS {m}" for m in MODEL_NAMES)
    + " FROM preds GROUP BY id",
)
def align_models(t: Inputs) -> DataFrame:
    wide = ensemble.aligned_models(t.predictions, MODEL_NAMES)
    return wide.select("id", *[L.joined(m).alias(m) for m in MODEL_NAMES])


@query(
    "j5_lookup_group_totals",
    """SELECT c.data_type, c.label, c.n, s.total
       FROM (SELECT data_type, label, CAST(sum(y) AS BIGINT) AS n FROM gold_long GROUP BY ALL) c
       JOIN (SELECT data_type, CAST(sum(y) AS BIGINT) AS total FROM gold_long GROUP BY ALL) s
         ON c.data_type = s.data_type
       WHERE c.n > 0""",
)
def group_totals(t: Inputs) -> DataFrame:
    counts = stats.split_label_counts(t.gold)
    return stats.with_group_total(counts, stats.labels_per_split(t.gold))


@query("j6_apply_label_thresholds", "SELECT id, model, label, yhat FROM preds_long")
def label_thresholds(t: Inputs) -> DataFrame:
    long = reshape.score_elements(t.predictions, ("id", "model"), "yhat")
    return long.select("id", "model", label_at("pos").alias("label"), F.col("score").alias("yhat"))


ANCESTORS = """SELECT g.id, coalesce(string_agg(n.node, '|' ORDER BY n.node), '') AS nodes
       FROM gold g LEFT JOIN (
         SELECT DISTINCT l.id, c.node FROM gold_long l JOIN closure c ON l.label = c.label WHERE l.y = 1
       ) n ON g.id = n.id GROUP BY g.id"""


@query("j7_ancestors_from_edges", ANCESTORS)
def ancestors_from_edges(t: Inputs) -> DataFrame:
    """The hierarchy as a table of edges, its closure by joins."""
    table = hierarchy.ancestor_table(hierarchy_edges(t.spark))
    return hierarchy.with_ancestors(t.gold, table).select("id", F.array_join("nodes", "|").alias("nodes"))


@query("j7_add_ancestors", ANCESTORS)
def ancestors(t: Inputs) -> DataFrame:
    return t.gold.select("id", F.array_join(L.with_ancestors("labels"), "|").alias("nodes"))


@query(
    "j8_unused_ids",
    """SELECT id FROM docs WHERE id NOT IN (SELECT id FROM annotations)
       AND id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)""",
)
def unused(t: Inputs) -> DataFrame:
    return validate.unused_ids(t.gold.select("id"), t.annotations, t.logits)


@query(
    "j9_reorder_like",
    """SELECT d.label, d.n, r.rank FROM
         (SELECT label, CAST(sum(y) AS BIGINT) AS n FROM gold_long WHERE data_type = 'Development' GROUP BY label) d
       JOIN (SELECT label, CAST(row_number() OVER (ORDER BY sum(y) DESC, pos) AS INTEGER) AS rank
             FROM gold_long WHERE data_type = 'Train' GROUP BY label, pos) r ON d.label = r.label""",
)
def reorder(t: Inputs) -> DataFrame:
    train, development = (
        stats.label_support(t.gold.filter(F.col("data_type") == s)) for s in ("Train", "Development")
    )
    return stats.reorder_like(development, train)


# --- set operations

@query(
    "x1_union_all",
    "SELECT id, data_type FROM docs UNION ALL SELECT id, 'Annotated' FROM annotations UNION ALL SELECT id, 'Vector' FROM logits WHERE k = 0",
)
def union_all(t: Inputs) -> DataFrame:
    return reshape.union_all(
        [
            t.gold.select("id", "data_type"),
            t.annotations.select("id", F.lit("Annotated").alias("data_type")),
            t.logits.select("id", F.lit("Vector").alias("data_type")),
        ]
    )


@query(
    "x2_union_of_label_arrays",
    """SELECT p.id, p.model, coalesce(string_agg(p.label, '|' ORDER BY p.label) FILTER (WHERE p.y = 1 OR p.yhat = 1), '') AS labels
       FROM preds_long p GROUP BY ALL""",
)
def union_arrays(t: Inputs) -> DataFrame:
    gold = L.decode_array("y")
    return t.predictions.select("id", "model", L.joined(F.array_union(gold, F.col("labels"))).alias("labels"))


@query(
    "x3_same_key_sets",
    """SELECT 'annotations' AS side, count(DISTINCT id) = (SELECT count(*) FROM docs) AS same FROM annotations
       UNION ALL SELECT 'predictions', count(DISTINCT id) = (SELECT count(*) FROM docs) FROM preds""",
)
def same_keys(t: Inputs) -> DataFrame:
    def verdict(name: str, other: DataFrame) -> DataFrame:
        differences = validate.id_differences(t.gold, other)
        return differences.agg((F.count(F.lit(1)) == 0).alias("same")).select(F.lit(name).alias("side"), "same")

    return verdict("annotations", t.annotations).unionAll(verdict("predictions", t.predictions))


@query(
    "x4_intersect_label_arrays",
    """SELECT id, model, CAST(sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS INTEGER) AS n_common
       FROM preds_long GROUP BY ALL""",
)
def intersect_arrays(t: Inputs) -> DataFrame:
    gold = L.decode_array("y")
    return t.predictions.select("id", "model", F.size(F.array_intersect(gold, F.col("labels"))).alias("n_common"))


# --- validation

@query("v2_required_keys", "SELECT d.id, 'labels' AS missing FROM docs d LEFT JOIN annotations a ON d.id = a.id WHERE a.id IS NULL")
def required_keys(t: Inputs) -> DataFrame:
    labelled = t.annotations.select("id", F.array(F.col("quality").cast("string")).alias("labels"))
    records = t.gold.select("id").join(labelled, "id", "left")
    return validate.missing_keys(records).select("id", F.array_join("missing", "|").alias("missing"))


@query(
    "v3_unknown_labels",
    "SELECT d.id, d.source AS label FROM docs d JOIN annotations a ON d.id = a.id WHERE a.toxic = 1",
)
def unknown(t: Inputs) -> DataFrame:
    marked = t.gold.join(t.annotations, "id").select(
        "id",
        F.when(F.col("toxic") == 1, F.array_append("labels", F.col("source"))).otherwise(F.col("labels")).alias("labels"),
    )
    return validate.unknown_labels(marked)


@query(
    "v4_id_differences",
    """SELECT a.id, 'missing' AS problem FROM annotations a
       WHERE a.id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)
       UNION ALL SELECT CAST(e.vec_id AS VARCHAR), 'extra' FROM embeddings e
       WHERE CAST(e.vec_id AS VARCHAR) NOT IN (SELECT id FROM annotations)""",
)
def id_differences(t: Inputs) -> DataFrame:
    return validate.id_differences(t.annotations, t.logits)


@query(
    "v5_last_record_wins",
    """SELECT CAST(conv_id AS VARCHAR) AS id, turn AS record_no, role, text FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""",
)
def last_record(t: Inputs) -> DataFrame:
    turns = t.table("conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("record_no"), "role", "text"
    )
    return validate.last_record_wins(turns)


@query(
    "v6_misaligned_ids",
    """SELECT id, count(DISTINCT model) AS n_models FROM (
         SELECT id, 'documents' AS model FROM docs UNION ALL SELECT id, 'labels' FROM annotations
         UNION ALL SELECT CAST(vec_id AS VARCHAR), 'embeddings' FROM embeddings)
       GROUP BY id HAVING count(DISTINCT model) <> 3""",
)
def misaligned(t: Inputs) -> DataFrame:
    tables = {"documents": t.gold, "labels": t.annotations, "embeddings": t.logits}
    ids = [df.select("id", F.lit(name).alias("model")) for name, df in tables.items()]
    return validate.misaligned_ids(reshape.union_all(ids), n_models=3)


# --- binarising

@query(
    "f15_binarise_scores",
    """SELECT id, model, coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE score >= CAST(0.5 AS DOUBLE)), '') AS labels
       FROM scores GROUP BY ALL""",
)
def binarised(t: Inputs) -> DataFrame:
    return joined(apply_threshold(t.scores, 0.5), "model")
