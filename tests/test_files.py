"""Folders of documents with broken ones among them, and forests that are saved and loaded."""
from pyspark.sql import functions as F

from routegrid.operators import classify as K
from routegrid.operators import evaluate as J
from routegrid.sources import readers, writers


def test_routes_by_file_and_by_folder(spark, tmp_path):
    for name, text in (("route_12.json", '{"name": "a"}'), ("x3.json", '{"name": "b"'), ("7.json", '{"other": 1}')):
        (tmp_path / name).write_text(text)
    got = {r["route_id"]: (r["name"], r["_broken"]) for r in readers.read_routes(spark, str(tmp_path), "name string").collect()}
    assert got == {12: ("a", None), 3: (None, '{"name": "b"'), 7: (None, None)}
    docs = spark.createDataFrame([(1, '{"name": "a"}'), (2, "oops")], "route_id int, text string")
    writers.write_documents(docs, str(tmp_path / "out"), "route_id", "text")
    rows = {r["route_id"]: r for r in readers.read_routes(spark, str(tmp_path / "out")).collect()}
    assert rows[1]["name"] == "a" and rows[1]["_broken"] is None
    assert rows[2]["name"] is None and rows[2]["_broken"].strip() == "oops"


def test_settings_of_several_files(spark, tmp_path):
    docs = spark.createDataFrame([
        (1, '{"llm_models": {"m": {"internal_name": "i"}}, "defaults": {"model_type": "m"}}'), (2, "{"), (3, "{}")], "config_id int, text string")
    writers.write_documents(docs, str(tmp_path / "c"), "config_id", "text")
    models, defaults, broken = readers.read_configs(spark, str(tmp_path / "c"))
    assert [(r["config_id"], r["model_key"], r["internal_name"]) for r in models.collect()] == [(1, "m", "i")]
    assert [tuple(r) for r in defaults.collect()] == [(1, "model_type", "m")]
    assert [tuple(r) for r in broken.collect()] == [(2, "{")]


def test_bounded_rows_favour_small_classes(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 10, 0.0).otherwise(1.0).alias("label"))
    assert K.bounded(rows, 1000).count() == 1000
    kept = {r["label"]: r["count"] for r in K.bounded(rows, 200).groupBy("label").count().collect()}
    assert kept[0.0] == 10 and 130 < kept[1.0] < 250
    assert sorted(r["id"] for r in K.bounded(rows, 200).collect()) == sorted(r["id"] for r in K.bounded(rows.repartition(3), 200).collect())


def test_scores_from_texts_equal_those_from_keys(spark):
    truth = spark.createDataFrame([(1, 0, "CCO"), (1, 1, "CCO"), (2, 0, "C(C"), (3, 0, None), (4, 0, "CC")], "id int, place int, smiles string")
    guess = spark.createDataFrame([(1, 0, "OCC"), (1, 1, "CC"), (2, 0, "C(C"), (3, 0, None), (5, 0, "CC")], "id int, place int, smiles string")
    by_text = {r["id"]: (r["any_correct"], r["all_correct"]) for r in J.score_predictions(truth, guess).collect()}
    by_key = {r["id"]: (r["any_correct"], r["all_correct"]) for r in J.correctness(J.with_keys(truth), J.with_keys(guess)).collect()}
    assert by_text == by_key == {1: (1, 0), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_rows_of_a_fit_are_dealt_evenly_whatever_the_classes(spark, monkeypatch):
    """Neither the draw by class nor the fit may leave the rows to as few tasks as there are classes."""
    rows = spark.range(0, 6000, 1, 8).selectExpr("id", "cast(id % 2 as double) AS label")
    drawn = K.bounded(rows, 3000)
    assert max(r["count"] for r in drawn.groupBy(F.spark_partition_id()).count().collect()) < 800
    seen = []
    monkeypatch.setattr(K, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, df: seen.append(df)})())
    K.train(rows.coalesce(1), most=20_000)
    dealt = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) == 6 and max(dealt) < 1300


def test_documents_are_written_by_many_tasks_and_listed_by_few(spark, tmp_path, monkeypatch):
    rows = spark.range(40).selectExpr("id AS route_id", "concat('{\"name\": \"', id, '\"}') AS text").coalesce(1)
    root = str(tmp_path / "docs")
    writers.write_documents(rows, root, "route_id", "text")
    files = list((tmp_path / "docs").glob("route_id=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, seen = spark.conf.get(key, None), []
    real = type(spark.read).json
    monkeypatch.setattr(type(spark.read), "json", lambda self, path: seen.append(spark.conf.get(key)) or real(self, path))
    got = {r["route_id"]: r["name"] for r in readers.read_routes(spark, root, "name string").collect()}
    assert got == {i: str(i) for i in range(40)}
    assert seen == [spark.conf.get("spark.sql.shuffle.partitions")] and spark.conf.get(key, None) == before
