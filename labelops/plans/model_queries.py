"""Model hooks and trained classifiers over the documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.functions.text import clean_text
from labelops.operators import models, reshape
from labelops.operators.curves import weighted_curve_metrics
from labelops.operators.batches import padded_scores, padding_share
from labelops.operators.training import JointClassifier, Training, train_jointly
from labelops.operators.translation import TranslationStore
from labelops.operators.translation import back_translate as back_translate_stored
from labelops.plans.inputs import Inputs, sql_text
from labelops.plans.registry import query
from labelops.plans.text_queries import clean_ctes
from labelops.session import scratch_path, stored
from labelops.sources.ledger import RunLedger

# One keyword per label position, and a second list for a second model.
KEYWORDS = (
    "the", "of", "and", "to", "a", "de", "der", "in", "is", "that",
    "for", "la", "it", "was", "on", "die", "with", "le", "und", "be",
)
OTHER_KEYWORDS = (
    "as", "by", "are", "this", "et", "at", "que", "les", "des", "from",
    "el", "an", "he", "von", "en", "un", "or", "zu", "no", "por",
)
SCORERS = {
    "keywords": partial(models.KeywordScorer, KEYWORDS),
    "other_keywords": partial(models.KeywordScorer, OTHER_KEYWORDS),
}

# A small glossary; it can be read backwards too.
GLOSSARY = {
    "the": "el", "of": "de", "and": "y", "to": "a", "in": "en", "is": "es",
    "that": "que", "for": "para", "it": "ello", "was": "fue", "on": "sobre", "with": "con",
}
BACKWARDS = {v: k for k, v in GLOSSARY.items()}


def glossary_sql(text: str, glossary: dict[str, str] = GLOSSARY) -> str:
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in glossary.items())
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _hits(keyword: str) -> str:
    return f"len(list_filter(words, lambda w: w = {sql_text(keyword)}))"


def _scored(model: str, keywords: tuple[str, ...]) -> str:
    scores = [f"({_hits(k)} / ({_hits(k)} + 1)::DOUBLE)" for k in keywords]
    return f"SELECT id, lang, '{model}' AS model, [{', '.join(scores)}] AS scores FROM tokens"


TOKENS = (clean_ctes(), "tokens AS (SELECT id, lang, string_split(processed_text, ' ') AS words FROM clean)")
LONG = "SELECT id, lang, model, CAST(r.i AS INTEGER) AS pos, round(scores[r.i + 1], 9) AS score FROM scored CROSS JOIN range(20) r(i)"


def _long(scored: DataFrame) -> DataFrame:
    cells = scored.select("id", "lang", "model", F.posexplode_outer("scores").alias("pos", "score"))
    return cells.withColumn("score", F.round("score", 9))


@query("u1_score_texts", LONG, *TOKENS, f"scored AS ({_scored('keywords', KEYWORDS)})")
def score(t: Inputs) -> DataFrame:
    texts = t.noisy.select("id", "lang", clean_text("text").alias("processed_text"))
    scored = models.score_texts(texts, SCORERS["keywords"])
    return _long(scored.withColumn("model", F.lit("keywords")))


@query(
    "u2_score_with_models",
    LONG,
    *TOKENS,
    f"scored AS ({_scored('keywords', KEYWORDS)} UNION ALL {_scored('other_keywords', OTHER_KEYWORDS)})",
)
def score_all(t: Inputs) -> DataFrame:
    texts = t.noisy.select("id", "lang", clean_text("text").alias("processed_text"))
    return _long(models.score_with_models(texts, SCORERS))


@query("u3_translate", f"SELECT id, {glossary_sql('processed_text')} AS processed_text FROM clean", clean_ctes())
def translate(t: Inputs) -> DataFrame:
    texts = t.noisy.select("id", clean_text("text").alias("processed_text"))
    return _store(t, "there", GLOSSARY).translate(texts, "processed_text")


@query(
    "u3_store_check",
    """SELECT count(*) AS n_rows, count(DISTINCT text) AS texts, count(DISTINCT text) AS translated, 0::BIGINT AS translated_again
       FROM (SELECT text FROM docs UNION ALL SELECT text FROM docs)""",
)
def translation_store(t: Inputs) -> DataFrame:
    """Every document twice: each text is translated once, and not again in a second run."""
    store = _store(t, "there", GLOSSARY)
    twice = t.gold.select("text").unionAll(t.gold.select("text"))
    counts = []
    for _ in range(2):
        store.add(twice, "text")
        counts.append(t.spark.read.parquet(store.path).count())
    return twice.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("text").alias("texts"),
        F.lit(counts[0]).cast("long").alias("translated"),
        F.lit(counts[1] - counts[0]).cast("long").alias("translated_again"),
    )


def _store(t: Inputs, name: str, glossary: dict[str, str]) -> TranslationStore:
    return TranslationStore(t.spark, scratch_path(t.spark, name), partial(models.GlossaryTranslator, glossary))


@query(
    "u4_back_translate",
    f"SELECT id, {glossary_sql('there', BACKWARDS)} AS processed_text FROM "
    f"(SELECT id, {glossary_sql('processed_text')} AS there FROM clean)",
    clean_ctes(),
)
def back_translate(t: Inputs) -> DataFrame:
    texts = t.noisy.select("id", clean_text("text").alias("processed_text"))
    return back_translate_stored(texts, _store(t, "there", GLOSSARY), _store(t, "back", BACKWARDS))


def _labelled(t: Inputs) -> DataFrame:
    """Documents with human labels: (id, data_type, text, y) for low quality and toxic."""
    y = F.array(1 - F.col("quality"), F.col("toxic"))
    # Joined first, so that only documents with labels are cleaned.
    documents = t.gold.select("id", "data_type", "text").join(t.annotations, "id")
    return documents.select("id", "data_type", clean_text("text").alias("text"), y.alias("y"))


def _labelled_once(t: Inputs) -> DataFrame:
    """The same, cleaned and joined once for all the runs that read it."""
    return stored(_labelled(t), "labelled")


def _split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("data_type") == name)


EPOCHS = 10
TOKEN_BUDGET = 1 << 14


def _trained(t: Inputs) -> JointClassifier:
    return train_jointly(_split(_labelled(t), "Train"), 2, max_epochs=EPOCHS).classifier


@query("u1_score_in_batches")
def score_in_batches(t: Inputs) -> DataFrame:
    """All documents scored by a trained model, in batches padded to a token budget."""
    texts = t.noisy.select("id", "lang", clean_text("text").alias("text"))
    scored = padded_scores(texts, _trained(t), TOKEN_BUDGET)
    # Scores are never empty; without "outer" a filter on them is inferred, for which all texts are cleaned and scored again.
    return scored.select("id", "lang", F.posexplode_outer("scores").alias("pos", "score"))


@query(
    "u1_batches_check",
    """SELECT count(*) AS n, CAST(sum(len(list_filter(string_split(processed_text, ' '), lambda w: w <> ''))) AS BIGINT) AS n_tokens,
              TRUE AS same_scores, TRUE AS little_padding FROM clean""",
    clean_ctes(),
)
def batches_check(t: Inputs) -> DataFrame:
    """Batches change no score, and sorting by length leaves less padding than taking rows as they come."""
    classifier = _trained(t)
    texts = stored(t.noisy.select("id", clean_text("text").alias("text")), "cleaned")
    batched = padded_scores(texts, classifier, TOKEN_BUDGET).withColumnRenamed("scores", "batched")
    scored = stored(classifier.scores(batched).select("n_tokens", "width", "batched", "scores"), "scored")
    differences = F.transform(F.arrays_zip("scores", "batched"), lambda x: F.abs(x["scores"] - x["batched"]))
    as_they_come = padding_share(padded_scores(texts, classifier, TOKEN_BUDGET, by_length=False))
    return scored.agg(
        F.count("*").alias("n"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.max(F.array_max(differences)) < 1e-9).alias("same_scores"),
        F.lit(padding_share(scored) <= as_they_come).alias("little_padding"),
    )


@query("u5_train_classifier")
def train(t: Inputs) -> DataFrame:
    """Scores of all labelled documents by one model of both labels."""
    labelled = _labelled_once(t)
    classifier = train_jointly(_split(labelled, "Train"), 2, max_epochs=EPOCHS).classifier
    return classifier.scores(labelled).select("id", "data_type", F.posexplode_outer("scores").alias("pos", "score"))


@query(
    "u5_training_check",
    """SELECT a.data_type, CAST(r.i AS INTEGER) AS pos, count(*) AS n,
              CAST(sum(CASE WHEN r.i = 0 THEN 1 - a.quality ELSE a.toxic END) AS BIGINT) AS positives, TRUE AS scores_are_probabilities,
              CASE WHEN a.data_type = 'Train' THEN TRUE END AS positives_score_higher
       FROM (SELECT a.*, d.data_type FROM annotations a JOIN docs d ON a.id = d.id) a CROSS JOIN range(2) r(i) GROUP BY a.data_type, r.i""",
)
def training_check(t: Inputs) -> DataFrame:
    """Every labelled document is scored once per label; learned labels separate the training rows."""
    labelled = _labelled_once(t)
    classifier = train_jointly(_split(labelled, "Train"), 2, max_epochs=EPOCHS).classifier
    cells = classifier.scores(labelled).select("data_type", F.posexplode(F.arrays_zip("y", "scores")).alias("pos", "cell"))
    score, y = F.col("cell.scores"), F.col("cell.y")
    higher = F.avg(F.when(y == 1, score)) > F.avg(F.when(y == 0, score))
    return cells.groupBy("data_type", "pos").agg(
        F.count("*").alias("n"),
        F.sum(y.cast("long")).alias("positives"),
        F.bool_and(score.between(0, 1)).alias("scores_are_probabilities"),
        F.when(F.col("data_type") == "Train", higher).alias("positives_score_higher"),
    )


def _grid(t: Inputs, trainers: dict) -> tuple[RunLedger, dict, DataFrame, dict]:
    """All training rows, and a set where marked rows count three times."""
    labelled = _labelled_once(t)
    original = _split(labelled, "Train")
    marked = original.filter(F.array_contains("y", 1))
    sets = {"original_train": original, "balanced_train": reshape.union_all([original, marked, marked])}
    return RunLedger(t.spark, scratch_path(t.spark, "runs")), sets, labelled, trainers


def _interrupted(t: Inputs, trainers: dict) -> tuple[DataFrame, list[int]]:
    """A grid that stops after its first training set, goes on in a second call, and is complete in a third."""
    ledger, sets, labelled, trainers = _grid(t, trainers)
    first = {"original_train": sets["original_train"]}
    calls = [(first, "first"), (sets, "second"), (sets, "third")]
    results = [models.resume_grid(ledger, s, labelled, trainers, "data_type", name) for s, name in calls]
    table = results[-1][0].withColumnRenamed("split", "data_type")
    return table, [len(trained) for _, trained in results]


@query("u6_run_grid")
def grid(t: Inputs) -> DataFrame:
    """Three classifiers on two training sets, some of them finished by an earlier call."""
    others = {k: e for k, e in models.candidate_estimators(max_iter=5).items() if k != "logistic_regression"}
    trainers = {"joint_logistic": models.joint_trainer(2, max_epochs=EPOCHS)}
    trainers |= {name: models.estimator_trainer(e, 2) for name, e in others.items()}
    return _interrupted(t, trainers)[0].drop("written_by")


@query(
    "u6_resume_check",
    """SELECT m.model, r.train_set, d.data_type, r.written_by, r.trained
       FROM (VALUES ('epochs_1'), ('epochs_2')) m(model)
       CROSS JOIN (VALUES ('original_train', 'first', 2), ('balanced_train', 'second', 2)) r(train_set, written_by, trained)
       CROSS JOIN (SELECT DISTINCT d.data_type FROM annotations a JOIN docs d ON a.id = d.id) d""",
)
def resume_check(t: Inputs) -> DataFrame:
    """Which call trained each run, and how many it trained; the third call trains none."""
    table, trained = _interrupted(t, {f"epochs_{n}": models.joint_trainer(2, max_epochs=n) for n in (1, 2)})
    counts = F.create_map(*[F.lit(v) for name, n in zip(("first", "second", "third"), trained) for v in (name, n)])
    return table.select("model", "train_set", "data_type", "written_by", F.element_at(counts, F.col("written_by")).alias("trained"))


def _with_validation(t: Inputs) -> tuple[Training, DataFrame]:
    labelled = _labelled_once(t)
    run = train_jointly(_split(labelled, "Train"), 2, max_epochs=EPOCHS, validation=_split(labelled, "Validation"), patience=3)
    return run, labelled


@query("u7_best_by_ap")
def early_stop(t: Inputs) -> DataFrame:
    """The best epoch of a run that stops when the validation AP no longer rises."""
    run, labelled = _with_validation(t)
    return run.table(labelled).filter("best").select("epoch", "loss", "ap")


@query("u8_training_history")
def history(t: Inputs) -> DataFrame:
    """Loss and validation AP of every epoch."""
    run, labelled = _with_validation(t)
    return run.table(labelled)


@query("u8_history_check", "SELECT TRUE AS loss_never_rises, TRUE AS best_is_first_maximum, TRUE AS best_weights_restored")
def history_check(t: Inputs) -> DataFrame:
    """What holds of every history, and of the classifier returned with it."""
    run, labelled = _with_validation(t)
    again = weighted_curve_metrics(run.classifier.scores(_split(labelled, "Validation")), []).select(F.col("ap").alias("again"))
    return (
        run.table(labelled)
        .withColumn("before", F.lag("loss").over(Window.partitionBy(F.lit(0)).orderBy("epoch")))
        .agg(
            F.bool_and(F.coalesce(F.col("loss") <= F.col("before"), F.lit(True))).alias("loss_never_rises"),
            (F.min(F.struct(-F.coalesce("ap", F.lit(-1.0)), "epoch")).getField("epoch") == F.max(F.when(F.col("best"), F.col("epoch")))).alias(
                "best_is_first_maximum"
            ),
            F.max(F.when(F.col("best"), F.col("ap"))).alias("ap"),
        )
        .crossJoin(again)
        .select("loss_never_rises", "best_is_first_maximum", F.col("ap").eqNullSafe(F.col("again")).alias("best_weights_restored"))
    )


def _timed(t: Inputs) -> DataFrame:
    return models.throughput(t.noisy.select("id", clean_text("text").alias("processed_text")))


@query("m14_throughput")
def throughput(t: Inputs) -> DataFrame:
    return _timed(t)


@query("m14_throughput_check", "SELECT count(*) AS samples, TRUE AS rates_agree FROM docs")
def throughput_check(t: Inputs) -> DataFrame:
    """All rows are counted by the timed write itself, and the rates follow from it."""
    near = lambda a, b: F.abs(a - b) <= 1e-9 * b
    steps = F.ceil(F.col("samples") / 8) / F.col("runtime_s")
    agree = near(F.col("samples_per_second"), F.col("samples") / F.col("runtime_s")) & near(F.col("steps_per_second"), steps)
    return _timed(t).select("samples", agree.alias("rates_agree"))
