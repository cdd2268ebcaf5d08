import json

import pytest
from pyspark.sql import functions as F

from labelops.operators import reshape, validate
from labelops.sources import io
from labelops.vocab import LABELS, NODES



def frame(spark, rows):
    return spark.createDataFrame(rows, "id STRING, labels ARRAY<STRING>")


def test_id_differences(spark):
    gold, predicted = frame(spark, [("001", []), ("1", []), ("x", [])]), frame(spark, [("1", []), ("1", []), ("y", [])])
    found = {(r["id"], r["problem"]) for r in validate.id_differences(gold, predicted).collect()}
    assert found == {("001", "missing"), ("x", "missing"), ("y", "extra")}
    assert not validate.same_keys(gold, predicted) and validate.same_keys(gold, gold)
    with pytest.raises(ValueError, match="differ in their ids"):
        validate.require_same_ids(gold, predicted)
    validate.require_same_ids(gold, gold)


def test_every_record_is_checked(spark):
    df = frame(spark, [("1", ["bad"]), ("2", ["Logos"]), ("3", None), (None, []), ("5", ["Smears", "worse"])])
    assert {tuple(r) for r in validate.unknown_labels(df).collect()} == {("1", "bad"), ("5", "worse")}
    assert {(r["id"], tuple(r["missing"])) for r in validate.missing_keys(df).collect()} == {
        ("3", ("labels",)), (None, ("id",)),
    }


def test_last_record_wins(spark):
    df = spark.createDataFrame([("1", 1, "a"), ("1", 3, "c"), ("1", 2, "b"), ("2", 9, "z")], "id STRING, record_no INT, v STRING")
    assert {r["id"]: r["v"] for r in validate.last_record_wins(df).collect()} == {"1": "c", "2": "z"}


def test_misaligned_and_unused(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a")], "id STRING, model STRING")
    assert [tuple(r) for r in validate.misaligned_ids(df, 2).collect()] == [("2", 1)]
    assert [r[0] for r in validate.unused_ids(df.select("id").distinct(), df.filter("model = 'b'")).collect()] == ["2"]


def test_json_array_and_malformed_file(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": "007", "labels": []}, {"id": "8", "labels": ["Smears"]}]), encoding="utf-8")
    bad.write_text('[{"id": "007", "labels": [', encoding="utf-8")
    assert [r["id"] for r in io.read_predictions(spark, str(good)).orderBy("id").collect()] == ["007", "8"]
    assert validate.malformed_records(io.read_checked(spark, str(good)).cache()).count() == 0
    assert validate.malformed_records(io.read_checked(spark, str(bad)).cache()).count() == 1


def test_unlabelled_and_multimodal(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"id": "1", "text": "a\nb", "image": "p.png"}]), encoding="utf-8")
    row = io.read_annotated(spark, str(path)).first()
    assert (row["id"], row["text"], row["image"], row["labels"]) == ("1", "a\nb", "p.png", None)


def test_prepared_csv_round_trip(spark, tmp_path):
    texts = [' outer blanks ', 'quote " and, comma', "line\nbreak", "back\\slash \\n", "#OnlyTag", "é漢😀"]
    rows = [(f"0{i}", t, "link", ["Smears"] if i % 2 else [], "" if i == 4 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id STRING, text STRING, link STRING, labels ARRAY<STRING>, processed_text STRING")
    wide = reshape.one_hot_encode(df).select("id", "text", "link", *[reshape.quoted(v) for v in LABELS], "processed_text")
    path = str(tmp_path / "csv")
    io.write_prepared_csv(wide, path)
    back = io.read_prepared_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
    io.write_prepared_csv(wide.limit(1), path, skip_existing=True)
    assert io.read_prepared_csv(spark, path).count() == len(texts)
    io.write_prepared_csv(wide.limit(1), path)
    assert io.read_prepared_csv(spark, path).count() == 1


def test_predictions_of_existing_models(spark, tmp_path):
    df = frame(spark, [("1", []), ("2", ["Doubt"])])
    path = str(tmp_path / "m1")
    io.write_predictions(df, path)
    paths = {("m1", "original_train"): path, ("m2", "original_train"): str(tmp_path / "none")}
    read, found = io.read_model_predictions(spark, paths, json_array=False)
    assert found == [("m1", "original_train")]
    assert {(r["id"], tuple(r["labels"]), r["model"]) for r in read.collect()} == {("1", (), "m1"), ("2", ("Doubt",), "m1")}
    with pytest.raises(FileNotFoundError):
        io.read_model_predictions(spark, {("m2", "x"): str(tmp_path / "none")})


def test_languages_are_tagged(spark, tmp_path):
    for lang in ("ar", "mk"):
        (tmp_path / f"{lang}.json").write_text(json.dumps([{"id": f"{lang}_1", "text": lang}]), encoding="utf-8")
    read = io.read_by_language(spark, {lang: str(tmp_path / f"{lang}.json") for lang in ("ar", "mk")})
    assert {(r["id"], r["lang"]) for r in read.collect()} == {("ar_1", "ar"), ("mk_1", "mk")}


def test_threshold_round_trip(spark, tmp_path):
    rows = [(m, v, 0.02 * (i + 41)) for m in ("a", "b") for i, v in enumerate(LABELS)]
    df = spark.createDataFrame(rows, "model STRING, label STRING, threshold DOUBLE")
    io.write_thresholds(df, str(tmp_path / "t"))
    assert {tuple(r) for r in io.read_threshold_lines(spark, str(tmp_path / "t")).collect()} == set(rows)


def test_label_list(spark, tmp_path):
    path = tmp_path / "classes.txt"
    path.write_text("  Smears \n\n   \nDoubt\n", encoding="utf-8")
    assert {r[0] for r in io.read_label_list(spark, str(path)).collect()} == {"Smears", "Doubt"}


def test_published_tables(spark, published):
    def starts(path, text):
        return open(path, encoding="utf-8").readline().strip() == text

    metric_files = [p for p in published(".csv") if starts(p, ",Label,ROC_AUC,AP")]
    table = io.read_label_metrics(spark, metric_files)
    assert table.count() == 480
    assert table.groupBy("model", "train_set", "split").count().filter("count = 20").count() == 24
    means = table.groupBy("model", "train_set", "split").agg(F.round(F.avg("ap"), 4).alias("ap"))
    assert {0.2693, 0.3599, 0.3101} <= {r["ap"] for r in means.collect()}
    runs = io.read_run_metrics(spark, [p for p in published(".csv") if p not in metric_files])
    assert runs.groupBy("model", "train_set", "split").count().count() == 24
    cuts = []
    for path in published(".json"):
        content = json.loads(open(path, encoding="utf-8").read())
        if isinstance(content, dict) and set(content) == set(LABELS):
            cuts.append(io.read_thresholds(spark, path, model=path))
    assert len(cuts) == 12 and reshape.union_all(cuts).count() == 240
    lists = [p for p in published(".txt") if set(open(p, encoding="utf-8").read().splitlines()) <= {*NODES, ""}]
    assert sorted(io.read_label_list(spark, p).count() for p in lists) == [28, 30]


def test_json_arrays(spark, tmp_path):
    rows = [(str(i), f'te"xt\n{i}', ["Smears"] * (i % 3), ["en", "fr", None][i % 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "id STRING, text STRING, labels ARRAY<STRING>, lang STRING")
    path = str(tmp_path / "whole")
    io.write_json_array(df.drop("lang").repartition(3), path)
    for file in (tmp_path / "whole").glob("*.txt"):
        assert isinstance(json.loads(file.read_text(encoding="utf-8")), list)
    back = io.read_annotated(spark, path).select("id", "text", "labels").collect()
    assert sorted(map(tuple, back)) == sorted(r[:3] for r in rows)
    io.write_json_array(df, str(tmp_path / "folders"), by=["lang"])
    read = io.read_language_folders(spark, str(tmp_path / "folders")).select("id", "text", "labels", "lang").collect()
    assert sorted(map(tuple, read), key=repr) == sorted(rows, key=repr)
    io.write_json_array(df.limit(0).drop("lang"), str(tmp_path / "none"))
    assert io.read_annotated(spark, str(tmp_path / "none")).count() == 0


def test_threshold_and_metric_folders(spark, tmp_path):
    rows = [(m, v, 0.02 * (i + 41)) for m in ("a", "b/c") for i, v in enumerate(LABELS)]
    io.write_threshold_folders(spark.createDataFrame(rows, "model STRING, label STRING, threshold DOUBLE"), str(tmp_path / "t"))
    assert {tuple(r) for r in io.read_threshold_folders(spark, str(tmp_path / "t")).collect()} == set(rows)
    metrics = [(1, "Smears", 0.5, None, "m", "x", "Train"), (2, 'a "label", b', 0.25, 1.0, "n", "x", "Train")]
    schema = "index INT, label STRING, roc_auc DOUBLE, ap DOUBLE, model STRING, train_set STRING, split STRING"
    io.write_metrics(spark.createDataFrame(metrics, schema), str(tmp_path / "m"))
    assert {tuple(r) for r in io.read_metrics(spark, str(tmp_path / "m")).collect()} == {r[1:] for r in metrics}
