"""The corpus pipeline on small tables: what goes, what stays, and in which form."""
from __future__ import annotations

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
staging = pytest.importorskip("routegrid.plans.staging")


def words(rng, n, stems):
    return " ".join("".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    en, es = ["the", "ing", "er", "th", "and", "wh"], ["que", "ci\u00f3n", "ar", "os", "el", "ll"]
    out = [(i, words(rng, rng.randrange(80, 140), en if i % 2 else es), "en" if i % 2 else "es") for i in range(60)]
    passage = words(rng, 70, en)
    test_item = words(rng, 20, en)
    out += [(100, out[1][1], "en"), (1, out[1][1], "en"), (101, out[3][1] + " more", "en")]  # copies and a repeated row
    out += [(102, words(rng, 60, en) + " " + passage, "en"), (103, passage + " " + words(rng, 60, en), "en")]
    out += [(104, test_item + " " + words(rng, 15, en), "en"), (105, None, "en"), (106, "", None), (107, " 12 ", "es"), (None, words(rng, 90, es), None), (None, None, None)]
    return out, passage, test_item


def written(spark, folder, docs, items):
    columns = "doc_id bigint, text string, lang string, _row_key string, ids string"
    spark.createDataFrame([(*r, "clash", "clash") for r in docs], columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run(spark, tmp_path, rows):
    docs, passage, item = rows
    got = pipeline.run(spark, written(spark, tmp_path, docs, [(1, item), (None, None)])).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
        assert r["n_tokens"] == len(r["ids"])
    assert all(len(v) == 1 for v in by_id.values())  # one row of each group of copies, repeated rows among them
    assert {105, 106, 107, 100, 101, 104}.isdisjoint(by_id) and {*range(60), 102, 103, None} == {*by_id}
    texts = {i: t for i, t, _ in reversed(docs)}
    for i in range(60):
        assert by_id[i][0]["text"] == texts[i]
    assert passage not in by_id[102][0]["text"] and passage not in by_id[103][0]["text"]


def test_stages_keep_their_columns(spark, tmp_path, rows):
    docs, _, item = rows
    folder = written(spark, tmp_path, [(i, t, None) for i, t, _ in docs], [(1, item)])
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.known_language(spark, table, folder)  # no labels: only texts without a letter go
    assert kept.columns == table.columns and kept.count() == len([t for _, t, _ in docs if any(map(str.isalpha, t or ""))])
    for _, stage in pipeline.STAGES[1:-1]:
        assert sorted(stage(spark, table, folder).columns) == sorted(table.columns)
    assert [name for name, _ in pipeline.STAGES] == ["language id", "n-gram jaccard join", "suffix-array dedup", "benchmark decontamination", "bpe encoding and decoding"]


def test_empty_table(spark, tmp_path):
    assert pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0


def test_disk_between_stages(spark, tmp_path, rows, monkeypatch):
    """A stage leaves two staged tables at most, of what it cuts; a run leaves none, and its outputs are written with the clean-up of shuffle files."""
    docs, _, item = rows
    root = tmp_path / "checkpoints"
    monkeypatch.setattr(pipeline, "checkpoint_root", lambda _: str(root))
    monkeypatch.setattr(staging, "checkpoint_root", lambda _: str(root))
    left, writes = [], []

    def staged():
        return {p.name for p in root.glob("staged/*")}

    def watched(stage):
        def run(*given):
            before = staged()
            out = stage(*given)
            left.append((len(before), len(staged() - before)))
            return out
        return run

    once = staging.write_once
    monkeypatch.setattr(pipeline, "STAGES", [(name, watched(stage)) for name, stage in pipeline.STAGES])
    monkeypatch.setattr(pipeline, "write_once", lambda df, path: writes.append(path) or once(df, path))
    pipeline.run(spark, written(spark, tmp_path / "tables", docs, [(1, item)]))
    assert [before for before, _ in left] == [0] * 5 and not staged() and len(writes) == 5
    assert [after for _, after in left[1:]] == [2, 1, 1, 0]
