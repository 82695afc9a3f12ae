"""Connected components of a link table, by contraction."""

from pyspark.sql import functions as F

from kinetable.session import checkpointed


def connected_components(edges, a="a", b="b"):
    """(node, label) for every node of ``edges``; the label is the smallest node of its component.

    Every round maps each node to the smallest of itself and its neighbours
    and keeps the links between different images.  Node ids should be well
    mixed (hashes), then a round leaves a fixed share of the nodes at most and
    the rounds are few.  Nothing but the number of links left reaches the driver.
    """
    links = checkpointed(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    )
    labels = None
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        images = checkpointed(
            both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("image"))
        )
        if labels is None:
            labels = images.select("node", F.col("image").alias("label"))
        else:
            renamed = images.select(F.col("node").alias("label"), "image")
            labels = labels.join(renamed, "label", "left").select("node", F.coalesce("image", "label").alias("label"))
        labels = checkpointed(labels)
        left = images.select(F.col("node").alias("a"), F.col("image").alias("x"))
        right = images.select(F.col("node").alias("b"), F.col("image").alias("y"))
        links = checkpointed(
            links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        )
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    return labels


def forest(pairs):
    """Those of the pairs that connect what is not yet connected, in order."""
    root, kept = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept
