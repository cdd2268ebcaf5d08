"""Sampling and class balancing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.operators import balance, models, reshape, stats
from labelops.plans.inputs import Inputs, joined
from labelops.plans.model_queries import BACKWARDS, GLOSSARY, glossary_sql
from labelops.plans.registry import query
from labelops.plans.text_queries import clean_ctes
from labelops.session import stored
from labelops.vocab import LABELS

SEED = 20


def sql_key(*parts: str) -> str:
    """The sampling key in SQL."""
    text = " || ':' || ".join([f"'{SEED}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


@query(
    "b1_sample_exact",
    f"""SELECT id, lang FROM (
          SELECT g.id, g.lang, row_number() OVER (ORDER BY {sql_key('g.id')}, g.id) AS r
          FROM gold_long g WHERE g.label = 'Smears' AND g.y = 1) WHERE r <= 30""",
)
def sample(t: Inputs) -> DataFrame:
    smears = reshape.with_label(t.gold, "Smears").select("id", "lang")
    return balance.sample_exact(smears, 30, SEED)


@query(
    "b2_sample_with_replacement",
    f"""SELECT d.id, r.i AS draw FROM range((SELECT count(*) * 2 FROM docs)) r(i)
        JOIN (SELECT id, row_number() OVER (ORDER BY {sql_key('id')}, id) AS rank FROM docs) d
          ON d.rank = {sql_key('r.i')} % (SELECT count(*) FROM docs) + 1""",
)
def draws(t: Inputs) -> DataFrame:
    documents = t.gold.select("id")
    return balance.sample_with_replacement(documents, 2 * documents.count(), SEED)


@query(
    "b3_label_shortfall",
    """SELECT data_type, label, CAST(sum(y) AS BIGINT) AS n, CAST(greatest(40 - sum(y), 0) AS BIGINT) AS shortfall
       FROM gold_long GROUP BY data_type, label""",
)
def shortfall(t: Inputs) -> DataFrame:
    return balance.label_shortfall(t.gold, 40, ["data_type"]).drop("pos")


@query(
    "b4_synthetic_rows",
    """SELECT 'aug-' || g.pos || '-' || g.id AS id, 'dummy' AS text, 'dummy' AS link, g.label AS labels, c.processed_text
       FROM gold_long g JOIN clean c ON g.id = c.id WHERE g.y = 1""",
    clean_ctes(source="docs"),
)
def synthetic(t: Inputs) -> DataFrame:
    chosen = t.prepared.select(F.col("id").alias("draw"), "processed_text").join(
        t.gold.select(F.col("id").alias("draw"), F.posexplode("y").alias("pos", "has")).filter("has = 1"), "draw"
    )
    return joined(balance.synthetic_rows(chosen), "text", "link", "processed_text")


def _balanced(t: Inputs) -> DataFrame:
    """Every label to a twelfth of the document count, rare labels by back translation."""
    prepared = stored(t.prepared.select("id", "text", "link", "labels", "processed_text"), "prepared")
    there, back = (partial(models.GlossaryTranslator, g) for g in (GLOSSARY, BACKWARDS))
    augment = partial(models.back_translate, there=there, back=back)
    return balance.balance(prepared, max(1, prepared.count() // 12), SEED, augment)


_SIZE = len(LABELS)
BALANCED = (
    clean_ctes(source="docs"),
    f"""target AS (SELECT greatest(1, count(*) // 12) AS n FROM docs),
held AS MATERIALIZED (
  SELECT pos, id, label, row_number() OVER (PARTITION BY pos ORDER BY {sql_key('pos', 'id')}, id) AS rank FROM gold_long WHERE y = 1),
support AS (SELECT v.pos, count(h.id) AS support FROM vocab v LEFT JOIN held h ON h.pos = v.pos GROUP BY v.pos),
ordered AS MATERIALIZED (SELECT pos, support, row_number() OVER (ORDER BY support, pos) AS step FROM support),
sums AS MATERIALIZED (
  SELECT pos, rank, list(s ORDER BY q) AS sums FROM (
    SELECT h.pos, h.rank, g.pos AS q, CAST(sum(g.y) OVER (PARTITION BY h.pos, g.pos ORDER BY h.rank) AS BIGINT) AS s
    FROM held h JOIN gold_long g ON g.id = h.id) GROUP BY pos, rank),
steps AS (
  SELECT 0::BIGINT AS step, CAST(NULL AS INTEGER) AS pos, 0::BIGINT AS take, 0::BIGINT AS make, list_transform(range({_SIZE}), lambda i: 0::BIGINT) AS counts
  UNION ALL
  SELECT o.step, o.pos, CASE WHEN x.sums IS NULL THEN 0 ELSE least(t.n - s.counts[o.pos + 1], o.support) END,
         CASE WHEN x.sums IS NULL THEN 0 ELSE greatest(t.n - s.counts[o.pos + 1] - o.support, 0) END,
         CASE WHEN x.sums IS NULL THEN s.counts
              ELSE list_transform(range(1, {_SIZE + 1}), lambda i: CASE WHEN i = o.pos + 1 THEN t.n ELSE s.counts[i] + x.sums[i] END) END
  FROM steps s JOIN ordered o ON o.step = s.step + 1 CROSS JOIN target t
  LEFT JOIN sums x ON x.pos = o.pos AND x.rank = least(t.n - s.counts[o.pos + 1], o.support)),
taken AS (
  SELECT h.id, d.text, d.source AS link, c.processed_text, g.labels
  FROM held h JOIN steps s ON s.pos = h.pos AND h.rank <= s.take JOIN docs d ON d.id = h.id JOIN clean c ON c.id = h.id JOIN gold g ON g.id = h.id),
draws AS (
  SELECT pos, i + 1 AS draw, CASE WHEN support >= make THEN i + 1 ELSE {sql_key("'draw-' || pos", 'i')} % support + 1 END AS rank
  FROM (SELECT s.pos, s.make, o.support, unnest(range(s.make)) AS i FROM steps s JOIN ordered o ON o.pos = s.pos WHERE s.make > 0)),
augmented AS (
  SELECT 'aug-' || w.pos || '-' || w.draw AS id, 'dummy' AS text, 'dummy' AS link, {glossary_sql(glossary_sql('c.processed_text'), BACKWARDS)} AS processed_text,
         h.label AS labels
  FROM draws w JOIN held h ON h.pos = w.pos AND h.rank = w.rank JOIN clean c ON c.id = h.id),
balanced AS (SELECT * FROM taken UNION ALL SELECT * FROM augmented)""",
)


@query("b5_balance", "SELECT * FROM balanced", *BALANCED, recursive=True)
def balanced(t: Inputs) -> DataFrame:
    return joined(_balanced(t), "text", "link", "processed_text")


_SHARES = """{name} AS (
  SELECT v.label, count(x.label) AS n_{name}, count(x.label)::DOUBLE / nullif(sum(count(x.label)) OVER (), 0) AS share_{name}
  FROM vocab v LEFT JOIN ({rows}) x ON x.label = v.label GROUP BY v.label)"""


@query(
    "b6_balance_report",
    "SELECT * FROM before JOIN after USING (label)",
    *BALANCED,
    _SHARES.format(name="before", rows="SELECT label FROM gold_long WHERE y = 1"),
    _SHARES.format(name="after", rows="SELECT unnest(string_split(labels, '|')) AS label FROM balanced"),
    recursive=True,
)
def report(t: Inputs) -> DataFrame:
    return stats.balance_report(t.gold, _balanced(t))
