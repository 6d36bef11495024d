"""The vector index against all pairs: recall, folders read, filters, changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.vector_index import VectorIndex

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(rows.embedding).astype(float)
    return rows.vec_id.to_numpy(), x / np.linalg.norm(x, axis=1)[:, None], rows.label.to_numpy()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return VectorIndex.build(spark.read.parquet(f"{SF}/embeddings.parquet"), str(tmp_path_factory.mktemp("ix")), "vec_id", "embedding", ["label"], lists=20)


def recall(got, ids, x, questions, keep=None):
    hit = 0
    keep = np.ones(len(ids), bool) if keep is None else keep
    for i, q in enumerate(questions):
        best = set(ids[keep][np.argsort(-(x[keep] @ q), kind="stable")[:10]].tolist())
        mine = [r for r in got if r.question == i]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11))
        assert all(abs(r.similarity - x[ids == r.vec_id][0] @ q / np.linalg.norm(q)) < 1e-9 for r in mine)
        hit += len(best & {r.vec_id for r in mine})
    return hit / (10 * len(questions))


def test_recall_of_200_questions_and_folders_read(spark, index, table):
    ids, x, _ = table
    questions = x[np.random.default_rng(1).choice(len(x), 200, replace=False)]
    got = index.search(questions, 10, probes=16)  # the vectors hardly cluster
    assert recall(got.collect(), ids, x, questions) >= 0.95
    lists = index.probed(questions[:1], 3)[0]
    one = index.read(lists)
    folders = lambda df: {r.f.split("list=")[1].split("/")[0] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert folders(one) == set(map(str, lists)) and len(folders(index.rows())) == 20
    assert "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString() or "PartitionFilters: [list" in one._jdf.queryExecution().toString()
    assert recall(index.search(questions[:5], 10, probes=20).collect(), ids, x, questions[:5]) == 1


def test_filter(index, table):
    ids, x, label = table
    got = index.search(x[:3], 10, probes=20, where=F.col("label") == 4).collect()
    assert recall(got, ids, x, x[:3], label == 4) == 1


def test_changes(spark, table, tmp_path):
    ids, x, label = (t[:300] for t in table)
    df = lambda i, v, lab: spark.createDataFrame([(int(a), [float(f) for f in b], int(c), "other") for a, b, c in zip(i, v, lab, strict=True)], "vec_id long, embedding array<double>, label int, spare string")
    index = VectorIndex.build(df(ids, x, label), str(tmp_path / "ix"), "vec_id", "embedding", ["label"], lists=6)
    index.upsert(df([5, 1000], [x[50], x[7]], [9, 9]))
    assert index.count() == 301
    best = [r.vec_id for r in index.search([x[50], x[7]], 2, probes=6).orderBy("question", "rank").collect()]
    assert best == [5, 50, 7, 1000]
    index.delete(df([5, 7, 99999], x[:3], [0, 0, 0]))
    assert index.count() == 299 and [r.vec_id for r in index.search([x[50], x[7]], 1, probes=6).orderBy("question").collect()] == [50, 1000]
    lonely = index.rows().groupBy("list").count().orderBy("count").first()["list"]
    index.delete(index.read([lonely]).select("vec_id"))
    assert lonely not in {r["list"] for r in index.rows().select("list").distinct().collect()}
    again = VectorIndex(spark, str(tmp_path / "ix"))
    assert again.count() == index.count() and again.keep == ["label"]


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (6, [1.0, 0.0]), (7, [None, 1.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), str(tmp_path / "a"), "vec_id", "embedding")
    assert [(r.vec_id, round(r.similarity, 6)) for r in index.search([[2.0, 0.0]], 5).orderBy("rank").collect()] == [(1, 1.0), (6, 1.0), (5, 0.707107)]
    index.upsert(spark.createDataFrame([(8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0])], "vec_id int, embedding array<double>"))
    assert index.count() == 4
    index.delete(index.rows().select("vec_id"))
    assert index.spark.read.schema("vec_id int, embedding array<double>, code binary, list int").parquet(f"{index.path}/lists").count() == 0


def test_scores_closer_than_codes_tell(spark, tmp_path):
    """Hundreds of vectors nearer to each other than the codes are exact, copies among them: still the exact nearest, ties by id."""
    r = np.random.default_rng(9)
    base, far = r.normal(size=(3, 16)), r.normal(size=(500, 16))
    x = np.concatenate([np.repeat(base[:1], 600, 0) + r.normal(size=(600, 16)) * 1e-4, np.repeat(base[1:2], 300, 0), far])
    rows = spark.createDataFrame([(len(x) - i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "ix"), "vec_id", "embedding", lists=4)
    got = sorted((t.question, t["rank"], t.vec_id) for t in index.search(base.tolist(), 10, probes=4).collect())
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score, ids = np.round(unit(base) @ unit(x).T, 9), len(x) - np.arange(len(x))
    assert got == [(i, k + 1, int(ids[j])) for i in range(3) for k, j in enumerate(np.lexsort((ids, -score[i]))[:10])]
