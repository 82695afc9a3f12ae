"""Splits, folds, neighbours and metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators import evaluate as ev
from kinetable.operators import knn


def labelled(spark, sizes):
    rows = [(i, c) for c, n in sizes.items() for i in range(c * 1000, c * 1000 + n)]
    return spark.createDataFrame(rows, "id long, label int")


def test_stratified_split_shares(spark):
    df = labelled(spark, {1: 100, 2: 33, 3: 2})
    split = ev.stratified_split(df, "id")
    counts = {(r["label"], r["side"]): r["count"] for r in split.groupBy("label", "side").count().collect()}
    assert counts == {(1, "test"): 25, (1, "train"): 75, (2, "test"): 8, (2, "train"): 25, (3, "test"): 1, (3, "train"): 1}
    again = ev.stratified_split(df.repartition(7), "id")
    assert split.exceptAll(again).count() == 0
    assert split.exceptAll(ev.stratified_split(df, "id", seed=1)).count() > 0


def test_ordered_split_cuts_at_the_end(spark):
    df = spark.range(10).select(F.lit("a").alias("session_id"), F.col("id").alias("seq"))
    split = {r["seq"]: r["side"] for r in ev.ordered_split(df).collect()}
    assert [s for s, side in split.items() if side == "test"] == [7, 8, 9]


def dealt_folds(labels, k):
    """Unshuffled stratified folds: deal the sorted classes out, then fill in order."""
    order = list(dict.fromkeys(labels))
    coded = [order.index(c) for c in labels]
    ranked = sorted(coded)
    folds = [None] * len(labels)
    for c in range(len(order)):
        shares = [sum(1 for x in ranked[i::k] if x == c) for i in range(k)]
        numbers = [f for f, n in enumerate(shares) for _ in range(n)]
        for place, i in enumerate(j for j, x in enumerate(coded) if x == c):
            folds[i] = numbers[place]
    return folds


@pytest.mark.parametrize("k", [2, 4, 5])
def test_folds(spark, k):
    rng = np.random.default_rng(k)
    labels = [int(c) for c in rng.choice([3, 1, 2], size=97, p=[0.6, 0.3, 0.1])]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label int")
    found = {r["id"]: r["fold"] for r in ev.stratified_folds(df, "id", k=k, slice_by=F.floor(F.col("id") / 10)).collect()}
    assert [found[i] for i in range(97)] == dealt_folds(labels, k)


def vectors(spark, n, dim, seed, clusters=4, offset=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(clusters, dim)) * 6
    label = rng.integers(0, clusters, n)
    x = centres[label] + rng.normal(size=(n, dim))
    rows = [(offset + i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int"), x, label


@pytest.mark.parametrize("pivots,block_rows,query_rows", [(1, 1000, 1000), (6, 40, 17), (25, 10, 1000)])
def test_neighbours_are_exact(spark, pivots, block_rows, query_rows):
    train, x, _ = vectors(spark, 300, 5, 1)
    asked, q, _ = vectors(spark, 60, 5, 2, offset=10_000)
    found = knn.k_nearest(train, asked, 7, pivots=pivots, block_rows=block_rows, query_rows=query_rows).collect()
    assert len(found) == 60 * 7
    distance = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))
    for i in range(60):
        mine = sorted((r["rank"], r["neighbour"], r["distance"]) for r in found if r["query"] == 10_000 + i)
        order = sorted(range(300), key=lambda j: (distance[i, j], j))[:7]
        assert [m[1] for m in mine] == order
        assert [m[2] for m in mine] == pytest.approx([distance[i, j] for j in order])


def test_neighbours_of_copies_and_few_rows(spark):
    """All training rows equal: ties go by key, and fewer than k rows are all returned."""
    train = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(5)], "id long, features array<double>, label int")
    asked = spark.createDataFrame([(9, [1.0, 2.0]), (10, [4.0, 6.0])], "id long, features array<double>")
    found = knn.k_nearest(train, asked, 3, pivots=4, block_rows=2).orderBy("query", "rank").collect()
    assert [r["neighbour"] for r in found] == [0, 1, 2, 0, 1, 2]
    assert [r["distance"] for r in found] == [0.0] * 3 + [5.0] * 3
    assert knn.k_nearest(train, asked, 50).count() == 10


def test_votes(spark):
    rows = [(1, 7, 0.0, 1), (1, 3, 0.5, 2), (1, 3, 0.5, 3), (2, 5, 1.0, 1), (2, 4, 2.0, 2), (2, 4, 2.0, 3), (3, 9, 1.0, 1), (3, 8, 1.0, 2)]
    found = spark.createDataFrame(rows, "query long, label int, distance double, rank int")
    by = lambda **o: {r["query"]: r["prediction"] for r in knn.vote(found, **o).collect()}
    assert by() == {1: 3, 2: 4, 3: 8}
    assert by(weights="distance") == {1: 7, 2: 4, 3: 8}
    assert by(k=1) == {1: 7, 2: 5, 3: 9}
    shares = {r["query"]: r["probabilities"] for r in knn.predict(found, [3, 4, 5, 7]).collect()}
    assert shares[1] == pytest.approx([2 / 3, 0, 0, 1 / 3])


def test_curve_with_ties_and_area(spark):
    scores = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.4, 0), (0.1, 1)]
    df = spark.createDataFrame(scores, "score double, hit long")
    points = ev.roc_points(df).orderBy(F.desc("threshold")).collect()
    assert [(r["tp"], r["fp"]) for r in points] == [(1, 0), (2, 1), (2, 3), (3, 3)]
    pairs = [(a, b) for a, h in scores if h for b, g in scores if not g]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert ev.auc(ev.roc_points(df)).first()["auc"] == pytest.approx(expected)


def test_area_equals_the_built_in_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(0)
    hit = rng.integers(0, 2, 2000)
    rows = [(float(s), int(h)) for s, h in zip(rng.normal(size=2000) + hit, hit)]
    df = spark.createDataFrame(rows, "score double, hit long")
    built_in = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="hit", numBins=0).evaluate(df)
    assert ev.auc(ev.roc_points(df)).first()["auc"] == pytest.approx(built_in)


def test_metrics_with_an_absent_class(spark):
    df = spark.createDataFrame([(1, 1, [0.9, 0.1, 0.0]), (2, 1, [0.6, 0.4, 0.0])], "label int, prediction int, probabilities array<double>")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in ev.confusion_matrix(df, [1, 2, 3]).collect()}
    assert len(cells) == 9 and cells[(1, 1)] == 1 and cells[(2, 1)] == 1 and sum(cells.values()) == 2
    metrics = {r["metric"]: r["value"] for r in ev.evaluate_model(df, [1, 2, 3], "m").collect()}
    assert metrics["accuracy"] == 0.5 and len(metrics) == 11
    # Hits 0.9 and 0.4 against 0.1, 0, 0.6, 0: seven of eight pairs are ordered.
    assert metrics["auc"] == pytest.approx(7 / 8)
    table = {r["actual"]: r["predicted_1"] for r in ev.confusion_table(df, [1, 2, 3]).collect()}
    assert table == {1: 1, 2: 1, 3: 0}


def test_blocks_of_large_cells_grow(spark):
    """Small asked blocks hold for small cells; a row of a large cell is not copied for thousands of them."""
    counts = np.array([0, 15, 130, 50_000, 2_000_000])
    assert knn.blocks(counts, 20, knn.BLOCK_ROWS, 64).tolist() == [1, 1, 7, 8, 100]
    assert knn.blocks(counts, 50, knn.QUERY_ROWS, 64).tolist() == [1, 1, 3, 10, 400]
    # Wide rows: the asked size is kept where a usual block would hold too many numbers.
    assert knn.blocks(counts, 1000, knn.BLOCK_ROWS, 10_000).tolist() == [1, 1, 1, 50, 2000]


def test_visits_come_in_tables_of_bounded_size(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 64))
    index = knn.NeighbourIndex(None, centres, np.full(300, 5), np.full(300, 100.0), [np.zeros(2)] * 300, 2, 10)
    asked = pd.DataFrame({"q_key": np.arange(200), "q_x": list(rng.normal(size=(200, 64)))})
    sizes = [len(x) for x in index.visits(asked, 2)]
    assert sum(sizes) == 200 * 300 and max(sizes) <= knn.BLOCK_VALUES // 64
