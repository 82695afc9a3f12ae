"""Splits, folds and metrics of classifiers, all as tables."""

from pyspark.sql import Window, functions as F

from kinetable.operators.ordering import running_totals, with_hash_order, with_position
from kinetable.session import checkpointed

TEST_SHARE = 0.25


def stratified_split(df, key, label="label", share=TEST_SHARE, seed=0, out="side"):
    """Reproducible split with the same share of every class on the test side.

    Rows of a class are ordered by a digest of their key; the first
    ``round(share * n)`` go to the test side.
    """
    hashed = with_hash_order(df, key, seed)
    placed = with_position(hashed, [label], ["_h", key], out="_pos", size_out="_n")
    first = F.floor(F.col("_n") * F.lit(share) + F.lit(0.5))
    side = F.when(F.col("_pos") < first, "test").otherwise("train")
    return placed.withColumn(out, side).drop("_h", "_pos", "_n")


def ordered_split(df, session="session_id", order=("seq",), share=TEST_SHARE, out="side", **options):
    """Unshuffled split: the last ``ceil(share * n)`` rows of a recording are the test side."""
    placed = with_position(df, [session], list(order), out="_pos", size_out="_n", **options)
    train = F.col("_n") - F.ceil(F.col("_n") * F.lit(share))
    side = F.when(F.col("_pos") < train, "train").otherwise("test")
    return placed.withColumn(out, side).drop("_pos", "_n")


def stratified_folds(df, key, label="label", k=4, out="fold", slice_by=None):
    """Fold number of every row: consecutive blocks of each class in key order.

    All rows sorted by class are dealt to the folds in turn to get each fold's
    share of a class, as unshuffled stratified k-fold does; classes count in
    the order of their first key.
    """
    placed = with_position(df, [label], [key], slice_by=slice_by, out="_pos")
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
    # One row per class.
    ahead = Window.partitionBy(F.lit(0)).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))

    def dealt(f):
        """Rows of the class whose place in the sorted whole is at most f modulo k."""
        def upto(n):
            return F.floor(n / k) * (f + 1) + F.least(n % k, f + F.lit(1))

        return upto(F.col("_start") + F.col("_n")) - upto(F.col("_start"))

    ends = starts.select(
        F.col(label).alias("_label"), F.array(*[dealt(f) for f in range(k)]).alias("_ends")
    )
    joined = placed.join(ends, F.col(label) == F.col("_label"))
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_pos")))
    return joined.withColumn(out, fold.cast("int")).drop("_pos", "_label", "_ends")


def accuracy(predictions, label="label", prediction="prediction"):
    hit = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    return predictions.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def batch_scores(predictions, batch=("batch",), prediction="prediction"):
    """Mean predicted class of every batch, and its most frequent class."""
    return predictions.groupBy(*batch).agg(
        F.avg(prediction).alias("score"), F.mode(prediction, True).alias("majority")
    )


def confusion_matrix(predictions, classes, label="label", prediction="prediction"):
    """Counts of all (true, predicted) pairs of the given classes, zeros included."""
    spark = predictions.sparkSession
    side = spark.createDataFrame([(int(c),) for c in classes], "c int")
    cells = side.select(F.col("c").alias("actual"), F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("predicted"))
    counts = predictions.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    joined = cells.join(counts, ["actual", "predicted"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_table(predictions, classes, label="label", prediction="prediction"):
    """The matrix with one column per predicted class."""
    matrix = confusion_matrix(predictions, classes, label, prediction)
    return matrix.groupBy("actual").agg(
        *[
            F.max(F.when(F.col("predicted") == int(c), F.col("n"))).alias(f"predicted_{c}")
            for c in classes
        ]
    )


def flattened_scores(predictions, classes, label="label", probabilities="probabilities"):
    """One (score, hit) row per row and class: the micro-averaged problem.

    ``probabilities`` is an array in the order of ``classes``; scores meet their
    class by position, so no row is lost when a class is absent.
    """
    pairs = F.arrays_zip(F.array(*[F.lit(int(c)) for c in classes]).alias("c"), F.col(probabilities).alias("p"))
    rows = predictions.select(F.col(label).cast("int").alias("_label"), F.explode(pairs).alias("_v"))
    return rows.select(
        F.col("_v.p").alias("score"),
        F.when(F.col("_label") == F.col("_v.c"), 1).otherwise(0).cast("long").alias("hit"),
    )


def roc_points(scores, score="score", hit="hit"):
    """ROC curve: one point per distinct score, from the highest one down.

    Scores are aggregated first; the running sums of the curve are formed in
    score ranges, so no task holds the whole curve.  The curve's origin is not
    a row of the table.  Runs one job for the ranges.
    """
    grouped = scores.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(hit).cast("long").alias("pos"), F.sum(1 - F.col(hit)).cast("long").alias("neg")
    )
    # One row a score, written once: the ranges, their totals and the sums each read it.
    points = running_totals(checkpointed(grouped), "threshold", ["pos", "neg"], descending=True)
    return points.select(
        "threshold", "pos", "neg",
        F.col("cum_pos").cast("long").alias("tp"),
        F.col("cum_neg").cast("long").alias("fp"),
        (F.col("cum_pos") / F.nullif("all_pos", F.lit(0))).alias("tpr"),
        (F.col("cum_neg") / F.nullif("all_neg", F.lit(0))).alias("fpr"),
    )


def auc(points):
    """Area under the curve by trapezoids between neighbouring points."""
    # The trapezoid of a point spans its own negatives; its mean height is the
    # count of positives above it plus half of its own.
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    scale = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return points.agg((area / F.nullif(scale, F.lit(0.0))).alias("auc"))


def micro_auc(predictions, classes, label="label", probabilities="probabilities"):
    return auc(roc_points(flattened_scores(predictions, classes, label, probabilities)))


def evaluate_model(predictions, classes, name, label="label", prediction="prediction", probabilities="probabilities"):
    """AUC, accuracy and all confusion counts of one model as (model, metric, value).

    The predictions are written out once, as every metric reads them.
    """
    predictions = checkpointed(predictions.select(label, prediction, probabilities))
    auc_rows = micro_auc(predictions, classes, label, probabilities).select(
        F.lit("auc").alias("metric"), F.col("auc").alias("value")
    )
    accuracy_rows = accuracy(predictions, label, prediction).select(
        F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")
    )
    cells = confusion_matrix(predictions, classes, label, prediction).select(
        F.concat_ws("_", F.lit("confusion"), F.col("actual"), F.col("predicted")).alias("metric"),
        F.col("n").cast("double").alias("value"),
    )
    rows = auc_rows.unionByName(accuracy_rows).unionByName(cells)
    return rows.select(F.lit(name).alias("model"), "metric", "value")
