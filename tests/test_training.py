"""Joint training against separate fits, epoch control, and the ledger of runs."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from labelops.operators import batches as batches_module
from labelops.operators import models, training
from labelops.operators.curves import label_curve_metrics
from labelops.operators.translation import TranslationStore
from labelops.sources.ledger import RunLedger


@pytest.fixture(scope="module")
def noisy(spark):
    """Two labels that words tell with some doubt, and one that is never there."""
    numbers = np.random.default_rng(2)
    table = []
    for i in range(600):
        y = [int(numbers.random() < 0.3), int(numbers.random() < 0.5), 0]
        words = [f"w{k}" for k in numbers.integers(0, 12, 5)]
        words += ["spam"] * int(numbers.random() < (0.8 if y[0] else 0.2)) + ["even"] * int(numbers.random() < (0.7 if y[1] else 0.3))
        table.append((" ".join(words), y, "Train" if i % 3 else "Validation"))
    return spark.createDataFrame([*table, (None, [0, 1, 0], "Train"), ("", [1, 0, 0], "Train")], "text STRING, y ARRAY<INT>, split STRING").cache()


def aucs(scored):
    return {r["pos"]: r["roc_auc"] for r in label_curve_metrics(scored, []).collect()}


def test_joint_training_equals_separate_fits(noisy):
    train, held_out = noisy.filter("split = 'Train' AND text <> ''"), noisy.filter("split = 'Validation'")
    joint = training.train_jointly(train, 3, max_epochs=40, n_features=512)
    separate = models.train_classifier(train, LogisticRegression(maxIter=100, regParam=0.01), 2, n_features=512)
    ours, theirs = aucs(joint.classifier.scores(held_out)), aucs(separate.scores(held_out))
    assert all(abs(ours[pos] - theirs[pos]) < 0.01 for pos in (0, 1)) and ours[0] > 0.7
    losses = [loss for _, loss, _ in joint.history]
    assert losses == sorted(losses, reverse=True) and losses[0] == pytest.approx(np.log(2))


def test_gradient_is_the_slope_of_the_loss(noisy):
    numbers = np.random.default_rng(4)
    rows = noisy.select(training.F.coalesce(training.hashed_words("text", 16), training.F.array().cast("array<int>")).alias("words"), "y")
    model = training.JointClassifier(numbers.normal(size=(17, 3)), numbers.random(16) + 0.5)
    loss, gradient = training._evaluate(rows, model, 602, 0.1)
    for at in ((0, 0), (7, 1), (16, 2)):
        step = np.zeros((17, 3))
        step[at] = 1e-5
        higher, _ = training._evaluate(rows, training.replace(model, weights=model.weights + step), 602, 0.1)
        assert (higher - loss)[at[1]] / 1e-5 == pytest.approx(gradient[at], abs=1e-4)


def test_early_stop_restores_the_best_epoch(noisy):
    train, held_out = noisy.filter("split = 'Train'"), noisy.filter("split = 'Validation'")
    run = training.train_jointly(train, 3, max_epochs=30, n_features=512, validation=held_out, patience=2)
    aps = [ap for _, _, ap in run.history]
    assert run.best_epoch == aps.index(max(aps)) and len(aps) <= run.best_epoch + 3
    assert models.weighted_curve_metrics(run.classifier.scores(held_out), []).first()["ap"] == max(aps)
    table = run.table(noisy).orderBy("epoch").collect()
    assert [r["epoch"] for r in table if r["best"]] == [run.best_epoch]


def test_warm_start_goes_on(noisy):
    train = noisy.filter("split = 'Train'")
    first = training.train_jointly(train, 3, max_epochs=6, n_features=512)
    more = training.train_jointly(train, 3, max_epochs=6, n_features=512, start=first.classifier)
    assert more.history[0][1] == pytest.approx(first.history[-1][1]) and more.history[-1][1] < first.history[-1][1]
    with pytest.raises(ValueError, match="weights"):
        training.train_jointly(train, 2, n_features=512, start=first.classifier)


def test_training_on_nothing(noisy):
    run = training.train_jointly(noisy.limit(0), 3, n_features=32)
    assert not run.classifier.weights.any() and len(run.history) == 1
    assert {tuple(r["scores"]) for r in run.classifier.scores(noisy).collect()} == {(0.5, 0.5, 0.5)}


def test_grid_goes_on_where_it_stopped(spark, noisy, tmp_path):
    ledger = RunLedger(spark, f"file:{tmp_path}/runs")
    calls = []

    def trainer(name, broken=False):
        def train(rows):
            calls.append(name)
            if broken:
                raise RuntimeError("lost")
            return training.train_jointly(rows, 3, max_epochs=1, n_features=64).classifier

        return train

    sets = {"all": noisy.filter("split = 'Train'"), "half": noisy.filter("split = 'Train'").limit(200)}
    with pytest.raises(RuntimeError):
        models.resume_grid(ledger, sets, noisy, {"a": trainer("a"), "b/c=d": trainer("b", broken=True)}, written_by="one")
    whole = {"a": trainer("a"), "b/c=d": trainer("b")}
    table, trained = models.resume_grid(ledger, sets, noisy, whole, written_by="two")
    assert trained == [("b/c=d", "all"), ("a", "half"), ("b/c=d", "half")] and calls == ["a", "b", "b", "a", "b"]
    rows = table.collect()
    assert {(r["model"], r["train_set"], r["split"]): r["written_by"] for r in rows} == {
        (m, s, split): "one" if (m, s) == ("a", "all") else "two" for m in whole for s in sets for split in ("Train", "Validation")
    }
    again, trained = models.resume_grid(RunLedger(spark, ledger.path), sets, noisy, whole, written_by="three")
    assert trained == [] and sorted(map(str, again.collect())) == sorted(map(str, rows)) and len(calls) == 5
    assert RunLedger(spark, f"file:{tmp_path}/none").table([("a", "all")]) is None


def test_token_batches():
    lengths = np.array([5, 1, 9, 0, 3, 3, 30])
    batches = list(batches_module.token_batches(lengths, 10))
    assert sorted(np.concatenate(batches).tolist()) == list(range(7))
    assert all(len(b) == 1 or lengths[b].max() * len(b) <= 10 for b in batches)
    assert list(batches_module.token_batches(np.array([], dtype=np.int64), 10)) == []


def test_padded_scores_are_the_same(noisy):
    classifier = training.train_jointly(noisy.filter("split = 'Train'"), 3, max_epochs=3, n_features=64).classifier
    both = classifier.scores(batches_module.padded_scores(noisy, classifier, 40).withColumnRenamed("scores", "batched"))
    for row in both.collect():
        assert row["batched"] == pytest.approx(row["scores"])
    assert batches_module.padding_share(both) <= batches_module.padding_share(batches_module.padded_scores(noisy, classifier, 40, by_length=False))


def test_texts_are_translated_once(spark, tmp_path):
    rows = [(i, f"text {i % 7}" if i % 5 else None) for i in range(60)] + [(60, "")]
    df = spark.createDataFrame(rows, "id INT, text STRING").repartition(4)
    path = f"file:{tmp_path}/store"

    def once():
        seen = set()

        def run(texts):
            assert not texts.duplicated().any() and not seen & set(texts)
            seen.update(texts)
            return [t.upper() for t in texts]

        return run

    def never():
        raise ValueError("nothing is left to translate")

    expected = sorted(((i, t and t.upper()) for i, t in rows), key=repr)
    got = TranslationStore(spark, path, once).translate(df)
    assert got.columns == df.columns and sorted((tuple(r) for r in got.collect()), key=repr) == expected
    assert spark.read.parquet(path).count() == 8
    again = TranslationStore(spark, path, never).translate(df)
    assert sorted((tuple(r) for r in again.collect()), key=repr) == expected
    more = df.unionByName(spark.createDataFrame([(61, "new")], df.schema))
    assert (61, "NEW") in [tuple(r) for r in TranslationStore(spark, path, once).translate(more).collect()]
    assert spark.read.parquet(path).count() == 9
