"""Embedding near-duplicates through an inverted multi-index.

Independent codebooks on the two halves of the vectors form a grid of cells;
every vector stands in its nearest one.  A query visits cells in the order of
the summed distances of its halves (multi-sequence traversal) until the target
recall is reached: the slack beyond the nearest cell is the quantile that
vectors at the threshold need, measured on simulated neighbours.  Blocks of
the visited cells are compared exactly in double precision.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.llm.base import query, table, written
from kinetable.llm.components import connected_components, forest

THRESHOLD = 0.98
TARGET_RECALL = 0.995
#: Vectors that codebooks and slack are fitted on, about; every vector is indexed.
SAMPLE = 20_000
#: Vectors a cell holds on average within one label.
CELL_VECTORS = 24
#: Vectors of a cell that are compared as one block.
BLOCK = 256


class Grid:
    """Codebooks of the two halves and the slack of the traversal."""

    def __init__(self, sample, centres, threshold, target, seed=7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [means(part, centres, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        # Neighbours exactly at the threshold, in random directions.
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        noise /= np.linalg.norm(noise, axis=1, keepdims=True) + 1e-300
        other = threshold * sample + np.sqrt(1 - threshold**2) * noise
        there, back = self.needed(sample, other), self.needed(other, sample)
        self.slack = float(np.quantile(np.minimum(there, back), target)) if len(sample) else 0.0

    def beyond(self, vectors):
        """Distances of both halves to all centres, less the nearest one's."""
        found = []
        for part, book in zip((vectors[:, : self.half], vectors[:, self.half :]), self.books):
            square = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)
            distance = np.sqrt(np.maximum(square, 0))
            found.append(distance - distance.min(axis=1, keepdims=True))
        return found

    def cells(self, vectors):
        """Nearest cell of each vector."""
        one, two = self.beyond(vectors)
        return np.argmin(one, axis=1), np.argmin(two, axis=1)

    def needed(self, queries, vectors):
        """Slack with which each query visits the cell of its vector."""
        one, two = self.beyond(queries)
        i, j = self.cells(vectors)
        rows = np.arange(len(queries))
        return one[rows, i] + two[rows, j]

    def visits(self, one, two):
        """Cells of one query in the order of their summed distance, as long as that is within the slack."""
        first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        queue, seen, found = [(0.0, 0, 0)], {(0, 0)}, []
        while queue:
            total, a, b = heapq.heappop(queue)
            if total > self.slack:
                break
            found.append((int(first[a]), int(second[b])))
            for x, y in ((a + 1, b), (a, b + 1)):
                if x < len(first) and y < len(second) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(queue, (float(one[first[x]] + two[second[y]]), x, y))
        return found


def means(points, centres, rng, rounds=12):
    """Centres of k-means, started from distinct random points."""
    points = np.unique(points, axis=0)
    book = points[rng.permutation(len(points))[:centres]].copy()
    for _ in range(rounds):
        nearest = np.argmin((book**2).sum(axis=1) - 2 * points @ book.T, axis=1)
        counts = np.bincount(nearest, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, points)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return book


def matrix(column):
    """Rows of an Arrow column of equally long float lists, in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def unit(vectors):
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def distinct_vectors(usable):
    """One row (uid, label, embedding, copies, first) for each different vector of a label."""
    return (
        usable.withColumn("uid", F.xxhash64("label", "embedding"))
        .groupBy("uid", "label", "embedding")
        .agg(F.count_distinct("vec_id").alias("copies"), F.min("vec_id").alias("first"))
    )


def fitted(vectors, threshold, target, sample=SAMPLE):
    """A Grid for the distinct vectors, fitted on about ``sample`` of them."""
    row = vectors.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    n, labels = row["n"], max(1, row["labels"])
    centres = max(2, int(round((n / labels / CELL_VECTORS) ** 0.5)))
    place = F.pmod(F.xxhash64(F.lit("grid"), "uid"), F.lit(1 << 20))
    chosen = vectors.where(place < int((1 << 20) * min(1.0, sample / max(1, n)))).select("embedding").toArrow()
    points = matrix(chosen.column("embedding").combine_chunks()) if chosen.num_rows else np.zeros((0, 2))
    if not len(points):
        return None
    points = unit(points)
    return Grid(points[np.lexsort(points.T)], centres, threshold, target)


def placed(vectors, held):
    """The vectors in their own cell, and the queries in every cell they visit."""

    def run(batches):
        grid = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(matrix(batch.column(2)))
            one, two = grid.beyond(points)
            rows, cells, own = [], [], []
            for r in range(len(points)):
                for c, (i, j) in enumerate(grid.visits(one[r], two[r])):
                    rows.append(r)
                    cells.append(i << 32 | j)
                    own.append(c == 0)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(cells, pa.int64()), pa.array(own, pa.bool_())], names=["uid", "label", "embedding", "copies", "cell", "own"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = vectors.select("uid", "label", "embedding", "copies")
    return rows.mapInArrow(run, f"uid long, label {kinds['label']}, embedding array<double>, copies long, cell long, own boolean")


def compared(held, threshold):
    """Function that compares a block of queries with a block of a cell's vectors.

    Gives rows (uid, other, n): with ``other`` null the copies that ``uid`` is
    linked with through this pair of blocks, else a link to connect.  A pair of
    vectors that finds itself from either side counts once on each side.
    """

    def run(key, rows):
        grid = held.value
        own = rows.column("stored").to_numpy(zero_copy_only=False).astype(bool)
        vectors = matrix(rows.column("embedding").combine_chunks())
        uid, copies = rows.column("uid").to_numpy(), rows.column("copies").to_numpy()
        asked, stored = np.flatnonzero(~own), np.flatnonzero(own)
        out = {"uid": [], "other": [], "n": []}
        if len(asked) and len(stored):
            lengths = np.sqrt((vectors**2).sum(axis=1))
            near = (vectors[asked] @ vectors[stored].T) / (lengths[asked][:, None] * lengths[stored][None, :]) >= threshold
            near &= uid[asked][:, None] != uid[stored][None, :]
            a, b = np.nonzero(near)
            if len(a):
                points = vectors / lengths[:, None]
                i, j = grid.cells(points[asked])
                one, two = grid.beyond(points[stored])
                returns = one[b, i[a]] + two[b, j[a]] <= grid.slack  # the stored one finds the query too
                there = np.bincount(a, weights=copies[stored][b], minlength=len(asked)).astype(np.int64)
                back = np.bincount(b[~returns], weights=copies[asked][a[~returns]], minlength=len(stored)).astype(np.int64)
                for places, counts in ((asked, there), (stored, back)):
                    some = np.flatnonzero(counts)
                    out["uid"] += uid[places[some]].tolist()
                    out["other"] += [None] * len(some)
                    out["n"] += counts[some].tolist()
                for x, y in forest(zip(uid[asked][a].tolist(), uid[stored][b].tolist())):
                    out["uid"].append(x)
                    out["other"].append(y)
                    out["n"].append(0)
        return pa.table({"uid": pa.array(out["uid"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "n": pa.array(out["n"], pa.int64())})

    return run


def near_duplicates(vectors, threshold=THRESHOLD, target=TARGET_RECALL):
    """Links and components of vectors (vec_id, embedding, label) at a cosine threshold, within labels.

    Returns vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable by links) and kept (vec_id = component_id).
    Links are exact where found; the traversal finds about ``target`` of those
    at the threshold and more of the closer ones.  A vector that is null, empty,
    zero or of another length than most, or holds a null or non-finite
    component, and one without label or vec_id, links with nothing.  Equal
    vectors of a label are one inside, so copies cost one row.  Repeated rows
    give equal rows and count as one vector.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    usable = rows.where(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    size = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    found = distinct_vectors(usable.where(F.size("embedding") == (size[0]["d"] if size else 0)))
    found = written(found, "vectors")
    grid = fitted(found, threshold, target)
    if grid is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    held = spark.sparkContext.broadcast(grid)
    cells = written(placed(found, held), "cells")

    # Cells are cut into blocks by their count, on both sides, and only cells that hold a vector are asked.
    counted = cells.groupBy("label", "cell").agg(F.sum(F.col("own").cast("long")).alias("stored"), F.count("*").alias("asked")).where("stored > 0 and asked > 1")
    parts = counted.select("label", "cell", F.ceil(F.col("stored") / BLOCK).alias("stored_parts"), F.ceil(F.col("asked") / BLOCK).alias("asked_parts"))
    spread = cells.join(parts, ["label", "cell"]).withColumn("h", F.xxhash64(F.lit("block"), "uid"))
    queries = spread.withColumn("q", F.pmod("h", "asked_parts")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stored_parts") - 1)))
    kept = spread.where("own").withColumn("s", F.pmod("h", "stored_parts")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asked_parts") - 1)))
    columns = ["label", "cell", "q", "s", "uid", "embedding", "copies"]
    pairs = queries.select(*columns, F.lit(False).alias("stored")).unionByName(kept.select(*columns, F.lit(True).alias("stored")))
    results = written(pairs.groupBy("label", "cell", "q", "s").applyInArrow(compared(held, threshold), "uid long, other long, n long"), "compared")

    counts = results.where("other is null").groupBy("uid").agg(F.sum("n").alias("n"))
    labels = connected_components(results.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    known = found.join(counts, "uid", "left").join(labels.withColumnRenamed("node", "uid").withColumnRenamed("label", "root"), "uid", "left")
    known = known.withColumn("root", F.coalesce("root", "uid")).withColumn("links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    firsts = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(firsts, "root").select("uid", "links", "component")
    named = rows.withColumn("uid", F.when(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("label", "embedding")))
    out = named.select("vec_id", "uid").join(known, "uid", "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


@query("op7_embedding_near_dedup")
def op7_embedding_near_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "embeddings"))
