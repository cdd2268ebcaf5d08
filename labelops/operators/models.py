"""Hooks for user-supplied models, and text classifiers from Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from time import perf_counter

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from labelops.arrow import text_slices
from labelops.functions.scores import sigmoid
from labelops.operators.curves import weighted_curve_metrics
from labelops.operators.metrics import best_run
from labelops.operators.reshape import union_all
from labelops.operators.thresholds import sweep_maxima
from labelops.operators.training import JointClassifier, train_jointly
from labelops.session import materialise
from labelops.sources.ledger import RunLedger
from labelops.vocab import LABELS

Scorer = Callable[[pd.Series], Sequence[Sequence[float]]]
Translator = Callable[[pd.Series], Sequence[str]]


#: Arrow type of the scores of a row.
SCORES = pa.list_(pa.float64())


def _score_rows(rows: Iterable[Sequence[float]]) -> pa.Array:
    return pa.array([list(map(float, row)) for row in rows], SCORES)


def scores_from(make_scorer: Callable[[], Scorer], text: str = "processed_text") -> Column:
    """Scores of a text column by a user-supplied model, in Arrow batches.

    The model is made once per task that has rows; only the text column goes to Python.
    A batch is scored in slices of bounded bytes, so that what a model makes of
    its texts does not grow with their length.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = None
        for texts in batches:
            scorer = scorer or make_scorer()
            parts = [_score_rows(scorer(texts.slice(*at).to_pandas())) for at in text_slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], SCORES)

    return run(text)


def score_texts(df: DataFrame, make_scorer: Callable[[], Scorer], text: str = "processed_text") -> DataFrame:
    """Add ``scores``, one per label in vocabulary order."""
    return df.withColumn("scores", scores_from(make_scorer, text))


def score_with_models(
    df: DataFrame, scorers: Mapping[str, Callable[[], Scorer]], text: str = "processed_text"
) -> DataFrame:
    """Scores by every model, one row per input row and model; one scan for all of them."""
    scored = df
    for i, make_scorer in enumerate(scorers.values()):
        scored = scored.withColumn(f"scores_{i}", scores_from(make_scorer, text))
    per_model = F.array(
        *[F.struct(F.lit(name).alias("model"), F.col(f"scores_{i}").alias("scores")) for i, name in enumerate(scorers)]
    )
    return scored.select(*df.columns, F.inline(per_model))


def translate(df: DataFrame, make_translator: Callable[[], Translator], text: str = "text") -> DataFrame:
    """Replace a text column by its translation, in slices of bounded bytes; other columns stay in the JVM."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        translator = None
        for texts in batches:
            translator = translator or make_translator()
            parts = [pa.array(list(translator(texts.slice(*at).to_pandas())), pa.string()) for at in text_slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.withColumn(text, run(text))


def back_translate(
    df: DataFrame,
    there: Callable[[], Translator],
    back: Callable[[], Translator],
    text: str = "processed_text",
) -> DataFrame:
    """Through a pivot language and back, for augmentation."""
    return translate(translate(df, there, text), back, text)


class KeywordScorer:
    """Deterministic stand-in for a model: hits / (hits + 1) of one keyword per label."""

    def __init__(self, keywords: Sequence[str]):
        self.keywords = list(keywords)

    def __call__(self, texts: pd.Series) -> list[list[float]]:
        words = texts.str.split(" ")
        hits = [[row.count(k) for k in self.keywords] for row in words]
        return [[h / (h + 1) for h in row] for row in hits]


class GlossaryTranslator:
    """Deterministic stand-in for a translator: word by word, unknown words kept."""

    def __init__(self, glossary: Mapping[str, str]):
        self.glossary = dict(glossary)

    def __call__(self, texts: pd.Series) -> list[str]:
        return [" ".join(self.glossary.get(w, w) for w in text.split(" ")) for text in texts]


def feature_pipeline(text: str = "text", n_features: int = 1 << 14) -> Pipeline:
    words = RegexTokenizer(inputCol=text, outputCol="words", pattern=" ")
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=n_features)
    return Pipeline(stages=[words, counts, IDF(inputCol="counts", outputCol="features")])


def candidate_estimators(max_iter: int = 10) -> dict[str, Estimator]:
    """The classifiers tried by default."""
    return {
        "logistic_regression": LogisticRegression(maxIter=max_iter, regParam=0.01),
        "naive_bayes": NaiveBayes(),
        "linear_svc": LinearSVC(maxIter=max_iter, regParam=0.01),
    }


@dataclass
class TextClassifier:
    """Features plus one binary model per label."""

    features: PipelineModel
    models: list[Model]

    def scores(self, df: DataFrame) -> DataFrame:
        """Add ``scores``, one probability per label."""
        columns = df.columns
        scored = self.features.transform(df)
        per_label = []
        for i, model in enumerate(self.models):
            model = model.copy()
            model.setPredictionCol(f"prediction_{i}").setRawPredictionCol(f"raw_{i}")
            if model.hasParam("probabilityCol"):
                model.setProbabilityCol(f"probability_{i}")
                per_label.append(vector_to_array(f"probability_{i}")[1])
            else:
                per_label.append(sigmoid(vector_to_array(f"raw_{i}")[1]))
            scored = model.transform(scored)
        return scored.select(*columns, F.array(*per_label).alias("scores"))

    def history(self) -> list[tuple[int, int, float]]:
        """(label position, iteration, loss) where the classifier keeps it."""
        return [
            (pos, i, float(loss))
            for pos, model in enumerate(self.models)
            if getattr(model, "hasSummary", False)
            for i, loss in enumerate(model.summary.objectiveHistory)
        ]


@contextmanager
def prepared_features(train: DataFrame, n_features: int = 1 << 14) -> Iterator[tuple[PipelineModel, DataFrame]]:
    """Fitted features and the training rows in them, kept while several models train."""
    features = feature_pipeline(n_features=n_features).fit(train)
    prepared = features.transform(train).select("features", "y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield features, prepared
    finally:
        prepared.unpersist()


def fit_labels(features: PipelineModel, prepared: DataFrame, estimator: Estimator, n_labels: int) -> TextClassifier:
    """One binary model per label on prepared rows."""
    models = [
        estimator.fit(prepared.select("features", F.col("y")[i].cast("double").alias("label"))) for i in range(n_labels)
    ]
    return TextClassifier(features, models)


def train_classifier(
    train: DataFrame, estimator: Estimator, n_labels: int = len(LABELS), n_features: int = 1 << 14
) -> TextClassifier:
    """Train on (text, y)."""
    with prepared_features(train, n_features) as (features, prepared):
        return fit_labels(features, prepared, estimator, n_labels)


def training_history(df: DataFrame, classifier: TextClassifier) -> DataFrame:
    """Loss per label and iteration as a table (a few rows per label)."""
    return df.sparkSession.createDataFrame(classifier.history(), "pos INT, iteration INT, loss DOUBLE")


def run_metrics(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Support-weighted AUC and AP, best F1 and best accuracy of each run."""
    return weighted_curve_metrics(scored, groups).join(sweep_maxima(scored, groups), list(groups))


def run_grid(
    train_sets: Mapping[str, DataFrame],
    evaluation: DataFrame,
    estimators: Mapping[str, Estimator],
    n_labels: int = len(LABELS),
    finished: Iterable[tuple[str, str]] = (),
    split: str = "split",
) -> DataFrame | None:
    """Run table (model, train_set, split, metrics) of all runs not yet finished.

    Features are fitted once per training set. The evaluation rows, tagged by
    ``split``, are scored once per run, stored, and measured all together.
    """
    done = set(finished)
    scored = []
    for train_set, train in train_sets.items():
        pending = {name: e for name, e in estimators.items() if (name, train_set) not in done}
        if not pending:
            continue
        with prepared_features(train) as (features, prepared):
            for model, estimator in pending.items():
                run = fit_labels(features, prepared, estimator, n_labels).scores(evaluation.select(split, "text", "y"))
                tags = [F.lit(model).alias("model"), F.lit(train_set).alias("train_set"), F.col(split).alias("split")]
                scored.append(run.select(*tags, "y", "scores"))
    if not scored:
        return None
    return run_metrics(materialise(union_all(scored)), ["model", "train_set", "split"])


def train_until_no_gain(
    train: DataFrame,
    validation: DataFrame,
    settings: Sequence[Estimator],
    n_labels: int = len(LABELS),
    patience: int = 3,
) -> tuple[TextClassifier, DataFrame]:
    """Try settings in turn, stop after ``patience`` without a better AP.

    Returns the best classifier and the table of all tries; the driver sees
    one number per try.
    """
    best, best_ap, since, tries = None, float("-inf"), 0, []
    with prepared_features(train) as (features, prepared):
        for i, estimator in enumerate(settings):
            classifier = fit_labels(features, prepared, estimator, n_labels)
            ap = weighted_curve_metrics(classifier.scores(validation.select("text", "y")), []).first()["ap"]
            tries.append((i, ap))
            if best is None or (ap is not None and ap > best_ap):
                best, best_ap, since = classifier, float("-inf") if ap is None else ap, 0
            else:
                since += 1
                if since >= patience:
                    break
    table = train.sparkSession.createDataFrame(tries, "setting INT, ap DOUBLE")
    return best, table


Trainer = Callable[[DataFrame], "TextClassifier | JointClassifier"]


def joint_trainer(n_labels: int = len(LABELS), **settings) -> Trainer:
    """Joint training with the given settings, for a grid of runs."""
    return lambda train: train_jointly(train, n_labels, **settings).classifier


@dataclass
class EstimatorTrainer:
    """One binary model per label; runs on the same training set can share its prepared rows."""

    estimator: Estimator
    n_labels: int

    def __call__(self, train: DataFrame) -> TextClassifier:
        return train_classifier(train, self.estimator, self.n_labels)

    def fit(self, features: PipelineModel, prepared: DataFrame) -> TextClassifier:
        return fit_labels(features, prepared, self.estimator, self.n_labels)


def estimator_trainer(estimator: Estimator, n_labels: int = len(LABELS)) -> Trainer:
    """One binary model per label, for a grid of runs."""
    return EstimatorTrainer(estimator, n_labels)


def resume_grid(
    ledger: RunLedger,
    train_sets: Mapping[str, DataFrame],
    evaluation: DataFrame,
    trainers: Mapping[str, Trainer],
    split: str = "split",
    written_by: str = "",
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Run what the ledger lacks of the grid, and read all of it back.

    Every run is committed as soon as its metrics are known, so an interrupted
    grid loses one run at most. Features of a training set are fitted once for
    all the estimators that need them. Returns the metrics of all runs of the grid,
    those finished earlier included, and the runs trained by this call.
    """
    grid = [(model, train_set) for train_set in train_sets for model in trainers]
    done = set(ledger.finished(grid))
    pending = [run for run in grid if run not in done]
    for train_set, train in train_sets.items():
        with ExitStack() as kept:
            prepared = None
            for model in [m for m, s in pending if s == train_set]:
                trainer = trainers[model]
                if isinstance(trainer, EstimatorTrainer):
                    prepared = prepared or kept.enter_context(prepared_features(train))
                    classifier = trainer.fit(*prepared)
                else:
                    classifier = trainer(train)
                scored = classifier.scores(evaluation.select(split, "text", "y"))
                rows = materialise(scored.select(F.col(split).alias("split"), "y", "scores"))
                ledger.record(model, train_set, run_metrics(rows, ["split"]), written_by)
    return ledger.table(grid), pending


def best_by_ap(runs: DataFrame, groups: Sequence[str] = ("split",)) -> DataFrame:
    return best_run(runs, "ap", groups)


def throughput(df: DataFrame, batch_size: int = 8) -> DataFrame:
    """Run the plan once for its full output: rows, seconds, rows and batches per second.

    The rows are counted while they are written, so nothing is read twice.
    """
    seen = Observation()
    started = perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("samples")).write.format("noop").mode("overwrite").save()
    seconds, samples = perf_counter() - started, seen.get["samples"]
    row = (samples, seconds, samples / seconds, -(-samples // batch_size) / seconds)
    return df.sparkSession.createDataFrame(
        [row], "samples BIGINT, runtime_s DOUBLE, samples_per_second DOUBLE, steps_per_second DOUBLE"
    )
