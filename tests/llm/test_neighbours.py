import math

import numpy as np
import pyspark.sql.functions as F
import pytest
from helpers import folder_tables
from pyspark.sql import DataFrame

from eventbook.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def search(df):
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def brute(vectors, query, k=20):
    scores = [(-sum(float(a) * float(b) for a, b in zip(v, vectors[query], strict=True)), i) for i, v in vectors.items() if i != query]
    return [i for _, i in sorted(scores)[:k]]


def test_recall_on_the_given_table(spark):
    df = folder_tables(spark, "embeddings")["embeddings"]
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    got = search(df)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hits = [len({v for v, _ in found} & set(brute(vectors, q))) / 20 for q, found in got.items()]
    assert np.mean(hits) >= 0.9


def test_recall_with_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 50)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 16))
    rows = {i: (centres[i % 12] + 0.6 * rnd.normal(size=16)).astype(np.float32) for i in range(3000)}
    got = search(spark.createDataFrame([(i, v.tolist(), None) for i, v in rows.items()], SCHEMA))
    hits = [len({v for v, _ in found} & set(brute(rows, q))) / 20 for q, found in got.items()]
    assert np.mean(hits) >= 0.9


def test_odd_vectors_and_ties(spark):
    bad = [(1000, None), (1020, [0.0, 0.0]), (1040, [1.0, None]), (1060, [math.nan, 1.0]), (1080, [math.inf, 1.0]), (1100, []), (1120, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    same = [(i, [0.3, 0.7]) for i in range(60)] + [(0, [0.3, 0.7])]
    got = search(spark.createDataFrame([(i, v, None) for i, v in bad + same], SCHEMA))
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        assert [v for v, _ in found] == [i for i in range(60) if i != q][:20]
        assert len({s for _, s in found}) == 1


def test_few_and_none(spark):
    got = search(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [-1.0, 0.1], 1)], SCHEMA))
    assert [v for v, _ in got[0]] == [1, 2]
    assert search(spark.createDataFrame([], SCHEMA)) == {}
    assert search(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == {}


def test_visits_go_on_until_there_are_enough_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 10)
    monkeypatch.setattr(neighbours, "calibrated", lambda *_: 1)
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=4).tolist(), None) for i in range(400)] + [(i, [30.0 + i, 0.0, 0.0, 0.0], None) for i in range(400, 403)]
    got = search(spark.createDataFrame(rows, SCHEMA))
    assert {q: len(found) for q, found in got.items()} == {q: 20 for q in range(0, 403, 20)}


def test_other_branches_return_what_reaches_the_nearest_one(spark, monkeypatch):
    """Rows that the branches return: at most a few for each answer, however many branches a query visits."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 20)
    monkeypatch.setattr(neighbours, "calibrated", lambda *_: 60)
    made = []
    first = neighbours.ranked_first

    def counted(found: DataFrame, k: int) -> DataFrame:
        made.append(found.count())
        return first(found, k)

    rnd = np.random.default_rng(2)
    centres = 4 * rnd.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rnd.normal(size=8)).tolist(), None) for i in range(2400)]
    monkeypatch.setattr(neighbours, "ranked_first", counted)
    got = search(spark.createDataFrame(rows, SCHEMA))
    assert all(len(found) == 20 for found in got.values()) and len(got) == 120
    assert made[-1] <= 3 * 20 * len(got)


def test_rows_of_a_turn_do_not_grow_with_the_branches(spark, monkeypatch):
    """Vectors without clusters: the nearest branch alone says little about what the others hold."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 10)
    monkeypatch.setattr(neighbours, "calibrated", lambda *_: 10_000)
    made = []
    first = neighbours.ranked_first

    def counted(found: DataFrame, k: int) -> DataFrame:
        made.append(found.count())
        return first(found, k)

    rnd = np.random.default_rng(6)
    rows = {i: rnd.normal(size=48).astype(np.float32) for i in range(3200)}
    monkeypatch.setattr(neighbours, "ranked_first", counted)
    got = search(spark.createDataFrame([(i, v.tolist(), None) for i, v in rows.items()], SCHEMA))
    assert all([v for v, _ in got[q]] == brute(rows, q) for q in (0, 1600, 3180))
    # The first is the calibration's.  Each turn also has the k rows of the turn before.
    assert max(made[1:]) <= 5 * 20 * len(got), made


def test_leaves_of_many_queries_as_of_each():
    """Ties, repeated vectors, leaves without rows, thresholds, and steps of a few products."""
    random = np.random.default_rng(5)
    rows = np.round(random.normal(size=(300, 7)), 1)
    rows[random.random(300) < 0.3] = rows[0]
    ids, leaf = random.permutation(600)[:300].astype(np.int64), random.integers(0, 6, 300) * 3
    queries, own = np.round(random.normal(size=(40, 7)), 1), np.where(np.arange(40) % 3 > 0, ids[:40], -5)
    leaves = [random.choice(np.arange(20), 1 + k % 7, replace=False) for k in range(40)]
    least = np.where(np.arange(40) % 2 > 0, -np.inf, random.normal(size=40) * 2)
    for products in (16, 5_000, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(neighbours, "PRODUCTS", products)
            at, found, scores = neighbours.best_in_leaves(rows, ids, leaf, queries, own, leaves, least, 9)
        for k in range(40):
            of = np.isin(leaf, leaves[k])
            want, reached = neighbours.best_of(rows[of], ids[of], queries[k], own[k], 9) if of.any() else (ids[:0], least[:0])
            good = reached >= least[k]
            assert found[at == k].tolist() == want[good].tolist() and scores[at == k].tolist() == reached[good].tolist()
