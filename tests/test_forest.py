"""Forests: every row counts, however many there are, and however a tree is dealt out."""
import numpy as np

from routegrid.operators import classify as K
from routegrid.operators import forest


def _rows(spark, n):
    """Class i % 3 shows in a third of the bits; the other bits are of no use."""
    bits = "transform(sequence(0, 39), j -> CAST(j * 50 + if(j % 2 = 0, id % 3, pmod(xxhash64(id, j), 40) + 5) AS int))"
    return spark.range(n).selectExpr("id", "cast(id % 3 AS double) AS label", f"{bits} AS input_bits", "array(3) AS output_bits")


def test_a_fit_counts_every_row(spark, monkeypatch):
    """No bound, draw or sample stands between the rows and the forest."""
    seen, real = [], forest.Forest._fit
    monkeypatch.setattr(forest.Forest, "_fit", lambda self, df: seen.append(df.count()) or real(self, df))
    monkeypatch.setattr(K, "bounded", lambda *a, **b: 1 / 0)
    K.train(K.features(_rows(spark, 300)), trees=2)
    assert seen == [300] and not hasattr(K, "FITTED")
    part = forest.grow(np.zeros((200_001, 1), np.uint8), np.r_[np.zeros(200_000, int), 1], np.ones(200_001, int), 1, 5, 8, 3, 2)
    assert part["n"].tolist() == [200_000, 1] and part["class"].tolist() == [0, 1]


def test_a_bit_of_one_row_in_many_can_split(spark):
    """Thresholds taken from a sample of rows would not know a bit that only the last row has."""
    x = np.zeros((30_000, 1), np.uint8)
    x[-1] = 1
    part = forest.grow(x, np.r_[np.zeros(29_999, int), 1], np.ones(30_000, int), 7, 5, 1, 1, 2)
    assert part["feature"].tolist() == [0, -1, -1] and part["n"].tolist() == [29_999, 1]


def test_trees_split_over_tasks_equal_those_grown_in_one(spark, tmp_path, monkeypatch):
    data = K.features(_rows(spark, 400).unionByName(_rows(spark, 50)))
    whole = K.train(data, trees=6)
    monkeypatch.setattr(forest, "LOCAL", 40)
    monkeypatch.setattr(forest, "DEALT", 900)
    monkeypatch.setattr(forest, "COUNTS", 64 * 3 * 4)
    parted = K.train(data, trees=6)
    K.save_model(parted, str(tmp_path / "m"))
    assert (parted.stages[0].top.feature >= 0).sum() >= 6
    weights = [sum(int(np.frombuffer(r["n"], np.int32).sum()) for r in m.stages[0].parts.collect()) for m in (whole, parted)]
    assert weights[0] == weights[1] and abs(weights[0] / (450 * 6) - 1) < 0.1
    a, b, c = ({r["id"]: r["prediction"] for r in K.predict(m, data).collect()} for m in (whole, parted, K.load_model(str(tmp_path / "m"))))
    assert a == b == c == {i: float(i % 3) for i in range(400)}


def test_rows_are_drawn_as_often_as_they_stand(spark):
    """The drawn number of a row that stands n times is Poisson of n."""
    row = np.arange(20_000)
    for n in (1, 7, 400, 10_000):
        times = forest._times(row, np.full(20_000, n), 5)
        assert abs(times.mean() / n - 1) < 0.05 and abs(times.var() / n - 1) < 0.1


def test_unseen_shapes_and_no_rows(spark):
    model = K.train(K.features(_rows(spark, 60)), trees=3)
    other = spark.createDataFrame([(1, [], []), (2, [2047], [2047])], "id int, input_bits array<int>, output_bits array<int>")
    assert {r["prediction"] for r in K.predict(model, K.features(other)).collect()} <= {0.0, 1.0, 2.0}
    assert K.predict(model, K.features(other.where("id > 2"))).count() == 0
    none = K.train(K.features(_rows(spark, 5).where("id > 9")), trees=3)
    assert [r["prediction"] for r in K.predict(none, K.features(other)).collect()] == [None, None]
