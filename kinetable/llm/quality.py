"""Quality by hierarchical empirical Bayes: what the text says, and what its site is like.

A logistic classifier over text measures gives each document evidence for good
quality as log odds against the base rate.  Grouped aggregation over hosts and
over paths within hosts gives their shares of good documents; sparse paths
shrink toward their host and sparse hosts toward the corpus, by strengths that
the spread between the groups determines.  The posterior of a document joins
its evidence with the prior of its path, the document itself left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.llm import textbytes as tb
from kinetable.llm.base import query, table, written

#: Labelled documents that the classifier is fitted on, about.
SAMPLE = 20_000
#: Bounds of a shrinkage strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
#: Documents with a lower posterior are rejected.
THRESHOLD = 0.5
#: Ids that may be sent to all executors; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

KINDS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 mark, 6 blank, 7 line end, 8 non-ASCII
for _kind, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b"#$%&*+/<=>@\\^_`{|}~[]"), (5, b"!?"), (6, (9, 11, 12, 13, 32)), (7, (10,)), (8, range(128, 256))):
    KINDS[list(_bytes)] = _kind
FEATURES = 10


def measures(data, offsets):
    """Text measures, one row a text: shares of kinds of characters, and of repeated words and lines."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    text_of = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(text_of * 9 + KINDS[data], minlength=9 * n).reshape(n, 9)
    starts, ends, counts = tb.word_spans(data, offsets, tb.BLANK_PARTED)
    words = tb.word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), counts)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    repeated = np.bincount(owner[again], minlength=n)
    pairs = tb.mixed(words * tb.STEP + np.roll(words, -1)) + owner.astype(np.uint64)
    whole = np.ones(len(words), dtype=bool)
    whole[np.cumsum(counts)[counts > 0] - 1] = False
    kept, of = np.unique(tb.mixed(pairs[whole]), return_index=True)
    distinct = np.bincount(owner[whole][of], minlength=n)
    total = np.maximum(1, lengths)
    letters = np.maximum(1, kinds[:, 1] + kinds[:, 2] + kinds[:, 8])
    spoken = np.maximum(1, counts)
    return np.stack(
        [
            np.sqrt(kinds[:, 4] / total),
            np.sqrt(kinds[:, 5] / total),
            kinds[:, 2] / letters,
            np.sqrt(kinds[:, 3] / total),
            np.sqrt(repeated / spoken),
            1 - distinct / np.maximum(1, counts - 1),
            letters / total,
            np.log1p(counts) / 10,
            np.minimum(lengths / spoken, 30) / 30,
            np.sqrt(kinds[:, 7] / total),
        ],
        axis=1,
    )


def measured(docs, keep):
    """The columns ``keep`` of the documents with their measures."""

    def run(batches):
        for rows, data, offsets in tb.steps(batches):
            values = measures(data, offsets).astype(np.float64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.record_batch([rows.column(rows.schema.get_field_index(c)) for c in keep] + [lists], names=[*keep, "measures"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, measures array<double>")


def expanded(values):
    """Measures with their squares."""
    return np.concatenate([values, values**2], axis=1)


def fit(docs, labels, sample=SAMPLE, penalty=1e-2, steps=25):
    """(weights, offset, base log odds) of a ridge logistic classifier, by Newton's method.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (0 or 1).
    About ``sample`` labels, chosen by a hash of the id, are sent to the tasks;
    their documents are measured and fitted.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = labels.count()
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20))
    few = labels.where(place < int((1 << 20) * min(1.0, sample / max(1, total))))
    chosen = measured(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), ["quality"])
    rows = sorted((r["quality"], r["measures"]) for r in chosen.toLocalIterator())
    labels = np.array([r[0] for r in rows], dtype=float)
    width = 2 * FEATURES
    if not len(rows) or labels.min() == labels.max():
        return np.zeros(width), 0.0, 0.0
    values = expanded(np.array([r[1] for r in rows]))
    middle, spread = values.mean(axis=0), values.std(axis=0) + 1e-6
    design = np.concatenate([(values - middle) / spread, np.ones((len(values), 1))], axis=1)
    ridge = np.diag(np.append(np.full(width, penalty * len(values) / 100), 1e-9))
    weights = np.zeros(width + 1)
    for _ in range(steps):
        likely = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (likely - labels) + ridge @ weights
        curve = (design * (likely * (1 - likely) + 1e-6)[:, None]).T @ design + ridge
        weights = weights - np.linalg.solve(curve, slope)
    share = labels.mean()
    own = weights[:-1] / spread
    return own, float(weights[-1] - middle @ own), float(np.log(share / (1 - share)))


def evidence(docs, model, keep):
    """The columns ``keep`` with ``logit``, the classifier's log odds, and ``likely``, its probability."""
    weights, offset, _ = model

    def run(batches):
        for rows, data, offsets in tb.steps(batches):
            logit = np.clip(expanded(measures(data, offsets)) @ weights + offset, -30, 30)
            yield pa.record_batch([rows.column(rows.schema.get_field_index(c)) for c in keep] + [pa.array(logit), pa.array(1 / (1 + np.exp(-logit)))], names=[*keep, "logit", "likely"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, logit double, likely double")


def strength(groups, prior):
    """Shrinkage strength of groups (n, good) toward their ``prior``, by the method of moments.

    The spread of the groups' shares beyond what their sizes explain gives the
    variance between them; the strength is that of the matching beta prior.
    """
    share = F.col("good") / F.col("n")
    noise = share * (1 - share) / F.col("n")
    row = groups.where("n > 1").agg(
        F.avg((share - prior) ** 2 - noise).alias("between"), F.avg(F.col("n")).alias("size"), F.avg(prior * (1 - prior)).alias("most")
    ).first()
    if row["between"] is None or row["most"] is None:
        return LEAST_STRENGTH
    if row["between"] <= 0:
        return MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, row["most"] / row["between"] - 1)))


def classify_quality(docs, labels, host="source", path="lang", threshold=THRESHOLD):
    """(doc_id, host, path, classifier, prior, posterior, kept) of documents (doc_id, text, host, path).

    ``labels`` (doc_id, quality) trains the classifier.  ``classifier``
    is the probability from the text alone, ``prior`` that of the path without
    the document, ``posterior`` both together; ``kept`` from ``threshold`` on.
    Null hosts and paths are groups of their own; a null or empty text has the
    classifier's answer to no characters.  Repeated rows give rows of their
    own, also with null ids.  Without labels of both kinds every document
    scores 0.5.  Other columns are ignored.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
    )
    model = fit(docs, labels)
    scored = written(evidence(docs, model, ["doc_id", "host", "path"]), "quality")
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("likely").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    corpus = (total["good"] or 0.0) / total["n"] if total["n"] else 0.5
    above = strength(hosts, F.lit(corpus))
    hosts = hosts.select(F.col("host").alias("of"), ((F.col("good") + above * corpus) / (F.col("n") + above)).alias("host_share"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    below = strength(paths, F.col("host_share"))
    known = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "host_share")
    joined = scored.join(known, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    prior = (F.col("good") - F.col("likely") + below * F.col("host_share")) / (F.col("n") - 1 + below)
    bounded = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("logit") - model[2] + F.log(F.col("prior") / (1 - F.col("prior")))
    return (
        joined.withColumn("prior", bounded)
        .withColumn("posterior", F.round(1 / (1 + F.exp(-odds)), 9))
        .select("doc_id", "host", "path", F.round("likely", 9).alias("classifier"), F.round("prior", 9).alias("prior"), "posterior", (F.col("posterior") >= threshold).alias("kept"))
    )


def drop_documents(docs, ids):
    """Documents without those of the given ids (doc_id).

    The ids are sent to all tasks up to BROADCAST_IDS, more meet the documents
    in a shuffled join.  Documents with a null id stay.
    """
    ids = written(ids.where("doc_id is not null").select("doc_id").distinct(), "dropped")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


@query("op6_quality")
def op6_quality(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    return classify_quality(docs, labels)
