"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``:

1. ``quality`` drops the documents whose posterior quality is below one half;
2. ``near_duplicates`` keeps of each group of near copies the smallest doc_id;
3. ``decontamination`` drops the documents that overlap with a benchmark item;
4. ``secrets`` masks secrets in the texts;
5. ``pieces`` gives each text's piece ids and their number.

Of conflicting labels of one document the smaller counts.  A doc_id names one
document: of rows that repeat it the second stage keeps one.  A row with a null doc_id cannot be named and passes the first two
stages.  Null texts pass every stage whose test they do not fail.
"""

from pyspark.sql import functions as F

from kinetable.llm import decontamination, ngram_join, piece_codec, quality, secret_scan
from kinetable.llm.base import small_batches, table, written
from kinetable.llm.pieces import default_model


def drop_low_quality(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = quality.classify_quality(docs, labels)
    return quality.drop_documents(docs, found.where("not kept"))


def drop_near_duplicates(spark, docs, sf_dir):
    found = ngram_join.ngram_jaccard_join(docs)
    kept = quality.drop_documents(docs, found.where(F.col("component_id") != F.col("doc_id")))
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return quality.drop_documents(kept, again).unionByName(repeated)


def drop_leaks(spark, docs, sf_dir):
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark, docs, sf_dir):
    return secret_scan.redact_secrets(docs, secret_scan.train(docs.select("doc_id", "text")))


def encode(spark, docs, sf_dir):
    return piece_codec.encode_pieces(docs, default_model())


def bounded(stage):
    """The stage with rows handed to Python workers in small batches: a stage's tasks stay within an executor's memory."""

    def run_stage(spark, docs, sf_dir):
        return stage(small_batches(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", bounded(drop_low_quality)),
    ("near_duplicates", bounded(drop_near_duplicates)),
    ("decontamination", bounded(drop_leaks)),
    ("secrets", bounded(mask_secrets)),
    ("pieces", bounded(encode)),
]

#: The stages go beyond SQL (a fitted classifier, automata, Markov models).
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
