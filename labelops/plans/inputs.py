"""Inputs of the registered queries, derived from the given tables.

The tables hold no multi-label annotations and no model scores, so gold
labels, scores and cut-offs are arithmetic on the document id and the label
position. They are computed per row as fixed-length arrays: no cross join, no
shuffle, and as many rows as there are documents. ``INPUT_CTES`` states the
same inputs in SQL, in long form.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.functions.text import clean_text
from labelops.operators.thresholds import apply_thresholds
from labelops.vocab import DISPLAY_ORDER, LABELS, NODES, closure, sql_string

# Six models, trained on two training sets.
MODELS = (
    ("m0", "original_train"),
    ("m1", "original_train"),
    ("m2", "original_train"),
    ("m3", "balanced_train"),
    ("m4", "balanced_train"),
    ("m5", "balanced_train"),
)
MODEL_NAMES = tuple(name for name, _ in MODELS)
SPLITS = ("Train", "Validation", "Development")


class Inputs:
    """The given tables and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def gold(self) -> DataFrame:
        """(id, text, lang, source, data_type, y, labels)."""
        has = [f"(doc_id * 29 + {pos * 13}) % {pos + 4} = 0" for pos in range(len(LABELS))]
        y = F.expr("array(" + ", ".join(f"cast({h} as int)" for h in has) + ")")
        labels = L.decode_array("y")
        day = F.col("doc_id") % 10
        split = F.when(day == 0, "Validation").when(day <= 2, "Development").otherwise("Train")
        return self.documents.select(
            F.col("doc_id").cast("string").alias("id"),
            "doc_id",
            "text",
            "lang",
            "source",
            split.alias("data_type"),
            y.alias("y"),
        ).withColumn("labels", labels)

    @cached_property
    def scores(self) -> DataFrame:
        """(id, lang, data_type, model, train_set, y, scores), one row per document and model."""
        models = ", ".join(
            f"named_struct('m', {m}, 'model', '{name}', 'train_set', '{train}')" for m, (name, train) in enumerate(MODELS)
        )
        scores = ", ".join(
            f"cast((doc_id * (31 + 2 * m) + {pos * 17} + m * 7) % 101 as double) / 101.0D * 0.7D + 0.3D * y[{pos}]"
            for pos in range(len(LABELS))
        )
        per_model = self.gold.drop("text", "labels").selectExpr("*", f"inline(array({models}))")
        return per_model.selectExpr(
            "id", "lang", "data_type", "model", "train_set", "y", f"array({scores}) as scores"
        )

    @cached_property
    def thresholds(self) -> DataFrame:
        """(model, label, threshold): 120 fixed cut-offs."""
        rows = ", ".join(
            f"('{name}', {sql_string(label)}, cast({27 + (pos * 7 + m * 3) % 22} as double) * 0.02D)"
            for pos, label in enumerate(LABELS)
            for m, name in enumerate(MODEL_NAMES)
        )
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, label, threshold)")

    @cached_property
    def predictions(self) -> DataFrame:
        """Scores plus ``yhat`` and the predicted ``labels``."""
        return apply_thresholds(self.scores, self.thresholds)

    @cached_property
    def noisy(self) -> DataFrame:
        """Documents with links, mentions, tags, emoji and contractions added: (id, lang, text)."""
        text, name = F.col("text"), F.col("doc_id").cast("string")
        kind = F.col("doc_id") % 8
        noisy = (
            F.when(kind == 0, F.concat(F.lit("RT @user_"), name, F.lit(" "), text))
            .when(kind == 1, F.concat(text, F.lit(" http://t.co/x"), name, F.lit("?a=1 end")))
            .when(kind == 2, F.concat(text, F.lit(" #OnlyTag")))
            .when(kind == 3, F.concat(F.lit("VIDEO: "), text, F.lit(" AUDIO: [link] [url] [user]")))
            .when(kind == 4, F.concat(text, F.lit(" 😀❤️ 漢字 (ok)! #tag-"), name))
            .when(kind == 5, F.concat(F.lit("We don't know, it's \\n "), text, F.lit(" they're sure they'll can't")))
            .when(kind == 6, F.concat(F.lit("  bit.ly/ab pic.twitter.com/q @ab @a "), text))
            .otherwise(text)
        )
        return self.documents.select(name.alias("id"), "lang", noisy.alias("text"))

    @cached_property
    def noisy_and_made(self) -> DataFrame:
        """The noisy documents, and a few made rows that cleaning empties."""
        made = "SELECT * FROM VALUES ('made-1', 'en', '#OnlyTag'), ('made-2', 'fr', ''), ('made-3', 'de', ' @ab bit.ly/x 😀 ') AS t(id, lang, text)"
        return self.noisy.unionByName(self.spark.sql(made))

    @cached_property
    def prepared(self) -> DataFrame:
        """(id, text, link, labels, processed_text, lang, data_type)."""
        return self.gold.select(
            "id",
            "text",
            F.col("source").alias("link"),
            "labels",
            clean_text("text").alias("processed_text"),
            "lang",
            "data_type",
        )

    @cached_property
    def logits(self) -> DataFrame:
        """Embedding elements as logits of 64 outputs, output k standing for class k modulo 10."""
        classes = F.expr("transform(sequence(0, 63), k -> cast(label = k % 10 as int))")
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("id"), "embedding", "label", classes.alias("y")
        )

    @cached_property
    def annotations(self) -> DataFrame:
        """Human document labels: (id, quality, toxic)."""
        return self.table("labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")


def joined(df: DataFrame, *extra: str, labels: str = "labels") -> DataFrame:
    """Result form of label arrays: sorted and joined."""
    return df.select("id", *extra, L.joined(labels).alias("labels"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    cell = lambda v: sql_text(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


_VOCAB = _values([(i, v, DISPLAY_ORDER.index(v) + 1) for i, v in enumerate(LABELS)])
_MODELS = _values([(i, name, train) for i, (name, train) in enumerate(MODELS)])
_CLOSURE = _values([(n, a) for n in NODES for a in sorted(closure(n))])

# The same inputs for the SQL side.
INPUT_CTES = f"""
vocab(pos, label, display_rank) AS (VALUES {_VOCAB}),
models(m, model, train_set) AS (VALUES {_MODELS}),
closure(label, node) AS (VALUES {_CLOSURE}),
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, lang, source,
         CASE WHEN doc_id % 10 = 0 THEN 'Validation' WHEN doc_id % 10 <= 2 THEN 'Development' ELSE 'Train' END AS data_type
  FROM documents),
gold_long AS (
  SELECT d.id, d.doc_id, d.lang, d.data_type, v.pos, v.label,
         CASE WHEN (d.doc_id * 29 + v.pos * 13) % (v.pos + 4) = 0 THEN 1 ELSE 0 END AS y
  FROM docs d CROSS JOIN vocab v),
gold AS (
  SELECT id, lang, data_type, coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE y = 1), '') AS labels
  FROM gold_long GROUP BY ALL),
scores AS (
  SELECT g.id, g.lang, g.data_type, m.m, m.model, m.train_set, g.pos, g.label, g.y,
         CAST((g.doc_id * (31 + 2 * m.m) + g.pos * 17 + m.m * 7) % 101 AS DOUBLE)
           / CAST(101 AS DOUBLE) * CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * g.y AS score
  FROM gold_long g CROSS JOIN models m),
thresholds AS (
  SELECT m.model, v.label, CAST(27 + (v.pos * 7 + m.m * 3) % 22 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS threshold
  FROM vocab v CROSS JOIN models m),
preds_long AS (
  SELECT s.*, CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END AS yhat
  FROM scores s JOIN thresholds t ON s.model = t.model AND s.label = t.label),
preds AS (
  SELECT id, lang, data_type, model, train_set,
         coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE yhat = 1), '') AS labels
  FROM preds_long GROUP BY ALL),
grid AS (SELECT i AS cut, CAST(i AS DOUBLE) * CAST(0.02 AS DOUBLE) AS threshold FROM range(50) r(i)),
noisy AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang, CASE doc_id % 8
    WHEN 0 THEN 'RT @user_' || CAST(doc_id AS VARCHAR) || ' ' || text
    WHEN 1 THEN text || ' http://t.co/x' || CAST(doc_id AS VARCHAR) || '?a=1 end'
    WHEN 2 THEN text || ' #OnlyTag'
    WHEN 3 THEN 'VIDEO: ' || text || ' AUDIO: [link] [url] [user]'
    WHEN 4 THEN text || ' 😀❤️ 漢字 (ok)! #tag-' || CAST(doc_id AS VARCHAR)
    WHEN 5 THEN 'We don''t know, it''s \\n ' || text || ' they''re sure they''ll can''t'
    WHEN 6 THEN '  bit.ly/ab pic.twitter.com/q @ab @a ' || text
    ELSE text END AS text
  FROM documents),
made AS (SELECT * FROM (VALUES ('made-1', 'en', '#OnlyTag'), ('made-2', 'fr', ''), ('made-3', 'de', ' @ab bit.ly/x 😀 ')) v(id, lang, text)),
noisy_and_made AS (SELECT id, lang, text FROM noisy UNION ALL SELECT * FROM made),
logits AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS id, CAST(r.i AS INTEGER) AS k, e.embedding[r.i + 1] AS logit,
         CASE WHEN e.label = r.i % 10 THEN 1 ELSE 0 END AS y
  FROM embeddings e CROSS JOIN range(64) r(i)),
annotations AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels)
"""


def with_inputs(body: str, *ctes: str, recursive: bool = False) -> str:
    """A statement over the inputs and further common table expressions."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([INPUT_CTES.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()
