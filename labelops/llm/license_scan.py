"""Licence scan: ordered signature rules over the words of a text.

A rule is tried only in texts that hold a keyword, where its anchor stands, and
only if its own keyword is among the next words.
Detections are spans of words. A detection inside one of the same or a better
rank is suppressed, so a sentence of a licence hides the names in it, and a
name with a version the bare name.

One pass over the detections in order of their starts tells what is inside what:
per rank it keeps how far the detections so far reach.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.llm.license_rules import BASE, RULES, WEIGHTS, WIDTH, Rule
from labelops.llm.running import bound, running

# Fixed value: what words are made of, in lower-case text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DETECTION = "struct<start:int,until:int,rank:int,place:int,label:string>"


_RULE_MAP = "map<string, array<struct<label:string,rank:int,place:int,keyword:string,pattern:string>>>"


def _rule_map(rules: tuple[Rule, ...]) -> Column:
    """Rules by anchor as one literal: map of word to rules. Places of the fixed phrases are below 0."""
    by_anchor: dict[str, list[dict]] = {}
    for place, rule in enumerate((*BASE, *rules), start=-len(BASE)):
        fields = {"label": rule.label, "rank": rule.rank, "place": place, "keyword": f" {rule.keyword}", "pattern": f"^ (?:{rule.pattern}) "}
        by_anchor.setdefault(rule.anchor, []).append(fields)
    return F.from_json(F.lit(json.dumps(by_anchor)), _RULE_MAP)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _found(words: Column, rules: tuple[Rule, ...]) -> Column:
    """All detections of the rules, in order of their starts."""
    anchors = F.array(*[F.lit(a) for a in dict.fromkeys(r.anchor for r in (*BASE, *rules))])
    by_anchor = _rule_map(rules)
    places = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("start"), w.alias("word"))), lambda p: F.array_contains(anchors, p["word"])
    )

    def at(place: Column) -> Column:
        window = F.concat(F.lit(" "), F.array_join(F.slice(words, place["start"] + 1, WIDTH), " "), F.lit(" "))

        def tried(text: Column) -> Column:
            matching = F.filter(
                F.element_at(by_anchor, place["word"]),
                lambda r: F.contains(text, r["keyword"]) & F.rlike(text, r["pattern"]),
            )

            def detection(rule: Column) -> Column:
                match = F.regexp_substr(text, rule["pattern"])
                length = F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit(""))) - 1
                return F.struct(
                    place["start"].alias("start"), (place["start"] + length).alias("until"),
                    rule["rank"].alias("rank"), rule["place"].alias("place"), rule["label"].alias("label"),
                )

            return F.transform(matching, detection)

        return bound(window, tried)

    return F.flatten(F.transform(places, at))


def _outermost(found: Column) -> Column:
    """Detections that are not inside one of the same or a better rank; of equal ones the first rule's."""
    order = lambda d: F.struct(d["start"], (-d["until"]).alias("until"), d["rank"], d["place"], d["label"])
    ordered = F.transform(F.array_sort(F.transform(found, order)), lambda d: F.struct(d["start"], (-d["until"]).alias("until"), d["rank"], d["place"], d["label"]))
    ranks = len(WEIGHTS)

    def step(reach: Column, d: Column) -> Column:
        inside = F.exists(F.slice(reach, 1, d["rank"] + 1), lambda until: until >= d["until"])
        further = F.transform(reach, lambda until, rank: F.when(rank == d["rank"], F.greatest(until, d["until"])).otherwise(until))
        return F.struct(further.alias("state"), F.when(~inside, d).alias("out"))

    start = F.array(*[F.lit(-1)] * ranks)
    return F.filter(running(ordered, start, step, DETECTION), lambda d: d.isNotNull())


def find_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, base, detections) for every row of ``docs`` (doc_id, text).

    ``base`` holds all places of the fixed phrases, ``detections`` those of the
    rules that nothing hides: arrays of start and end word (exclusive, from 0),
    rank, number of the rule and label. A null text counts as empty; texts are
    read whole; rows stay as they are, repeated ones and null ids too; other
    columns are dropped.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("promising", _promising(F.col("words"), rules))
    nothing = F.array().cast(f"array<{DETECTION}>")
    found = F.when(F.col("promising"), _found(F.col("words"), rules)).otherwise(nothing)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    base, others = (F.filter("found", test) for test in (lambda d: d["place"] < 0, lambda d: d["place"] >= 0))
    kept = F.when(F.size("found") > 0, _outermost(others)).otherwise(nothing)
    return rows.select("doc_id", "n_words", base.alias("base"), kept.alias("detections"))


def _promising(words: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text holds any keyword."""
    keywords = dict.fromkeys(word for rule in (*BASE, *rules) for word in rule.keywords)
    return F.arrays_overlap(words, F.array(*map(F.lit, keywords)))


def license_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; see ``find_licenses``.

    ``score`` is the weight of the best rank among the detections, 0 without any.
    """
    starts = F.transform("base", lambda d: d["start"])
    base_labels = F.transform("base", lambda d: d["label"])
    all_labels = F.concat(base_labels, F.transform("detections", lambda d: d["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_min(F.transform(F.concat("base", "detections"), lambda d: d["rank"]))
    weights = F.array(*map(F.lit, WEIGHTS))
    return find_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(all_labels).alias("labels"),
        F.coalesce(F.get(weights, best), F.lit(0.0)).alias("score"),
    )
