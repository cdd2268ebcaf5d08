"""SQL of queries that plain SQL can state in full, written out from their parameters."""

from __future__ import annotations

from labelops.llm import license_rules, phrase_trees, vector_codes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses() -> str:
    """Every rule at every anchor; a detection stays unless another one of the same or a better rank holds it."""
    rules = [(-1, r) for r in license_rules.BASE] + list(enumerate(license_rules.RULES))
    values = ", ".join(
        f"({place}, {r.rank}, {_text(r.label)}, {_text(r.anchor)}, {_text('^(?:' + r.pattern + ') ')})" for place, r in rules
    )
    weights = ", ".join(map(str, license_rules.WEIGHTS))
    return rf"""
WITH rules(place, rank, label, anchor, pattern) AS (VALUES {values}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
anchors AS (SELECT list(DISTINCT anchor) AS all_anchors FROM rules),
places AS (
  SELECT doc_id, w, unnest(list_filter(range(len(w)), lambda i: list_contains(all_anchors, w[i + 1]))) AS i FROM words, anchors),
tried AS (
  SELECT p.doc_id, p.i, r.place, r.rank, r.label, array_to_string(p.w[p.i + 1 : p.i + {license_rules.WIDTH}], ' ') || ' ' AS seen, r.pattern
  FROM places p JOIN rules r ON p.w[p.i + 1] = r.anchor),
found AS (
  SELECT doc_id, i AS start, i + len(m) - len(replace(m, ' ', '')) AS until, place, rank, label
  FROM (SELECT *, regexp_extract(seen, pattern) AS m FROM tried WHERE regexp_matches(seen, pattern))),
base AS (SELECT * FROM found WHERE place < 0),
others AS (SELECT * FROM found WHERE place >= 0),
kept AS (
  SELECT * FROM others d WHERE NOT EXISTS (
    SELECT 1 FROM others e WHERE e.doc_id = d.doc_id AND e.start <= d.start AND e.until >= d.until AND e.rank <= d.rank
      AND (e.start < d.start OR e.until > d.until OR e.rank < d.rank OR e.place < d.place))),
base_of AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
all_of AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(rank) AS rank
  FROM (SELECT * FROM base UNION ALL SELECT * FROM kept) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(b.n_base, 0) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
       CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       CASE WHEN a.rank IS NULL THEN 0.0::DOUBLE ELSE ([{weights}]::DOUBLE[])[a.rank + 1] END AS score
FROM words w LEFT JOIN base_of b USING (doc_id) LEFT JOIN all_of a USING (doc_id)
"""


def vector_rounds() -> str:
    """Plain rounds over all distances."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cells AS MATERIALIZED (
  SELECT k.vec_id, p.p, k.v[p.p * (len(k.v) // {parts}) + 1 : (p.p + 1) * (len(k.v) // {parts})] AS x
  FROM kept k CROSS JOIN range({parts}) p(p))""",
        f"""book0 AS MATERIALIZED (
  SELECT c.p, s.e, c.x FROM cells c JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) s USING (vec_id))""",
    ]
    near = """near{n} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT c.vec_id, c.p, b.e, CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM cells c JOIN book{n} b USING (p)) GROUP BY vec_id, p)"""
    for n in range(vector_codes.ROUNDS):
        steps.append(near.format(n=n))
        steps.append(
            f"""book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (
    SELECT p, e, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS x FROM (
      SELECT p, e, i, (s - ((s % c) + c) % c) // c AS floor_mean FROM (
        SELECT n.p, n.e, r.i, sum(c.x[r.i])::BIGINT AS s, count(*) AS c
        FROM near{n} n JOIN cells c USING (vec_id, p) CROSS JOIN LATERAL (SELECT unnest(range(1, len(c.x) + 1)) AS i) r
        GROUP BY n.p, n.e, r.i)) GROUP BY p, e) m USING (p, e))"""
        )
    last = vector_codes.ROUNDS
    steps.append(near.format(n=last))
    steps.append(
        f"""codes AS (
  SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id)"""
    )
    steps.append("of_label AS (SELECT k.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM codes c JOIN kept k USING (vec_id) GROUP BY k.label)")
    steps.append(
        f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})"
    )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT c.vec_id, c.code, c.error, l.label_error, g.codebooks_sha256\n"
        "FROM codes c JOIN kept k USING (vec_id) JOIN of_label l ON l.label IS NOT DISTINCT FROM k.label CROSS JOIN digest g"
    )


def phrases() -> str:
    """Counts of all runs of one to three words, and what follows from them."""
    least, contained, top = phrase_trees.LEAST, phrase_trees.CONTAINED, phrase_trees.TOP
    return rf"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, '{phrase_trees.UNKNOWN}') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents)),
numbered AS (SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM numbered),
following AS (
  SELECT lang, word, lead(word, 1) OVER p AS second, lead(word, 2) OVER p AS third FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
runs AS (
  SELECT lang, 1 AS k, word AS phrase FROM following
  UNION ALL SELECT lang, 2, word || ' ' || second FROM following WHERE second IS NOT NULL
  UNION ALL SELECT lang, 3, word || ' ' || second || ' ' || third FROM following WHERE third IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= {least}),
cuts AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, array_to_string(c.w[1 : c.k], ' ') AS l_phrase, array_to_string(c.w[c.k + 1 : c.words], ' ') AS r_phrase
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c),
rated AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.l_phrase JOIN counts r ON r.lang = c.lang AND r.phrase = c.r_phrase),
lowest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
explained AS (
  SELECT DISTINCT p.lang, p.phrase FROM candidates p JOIN (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE words = 3) t
    ON t.lang = p.lang AND t.phrase = p.phrase AND p.words = 2 AND 100 * t.a >= {contained} * p.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN explained USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}
"""
