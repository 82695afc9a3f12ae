"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches from the largest ids to the smallest.  A batch's
line hashes are merge-anti-joined with the sorted runs of the batches before
it: hashes no run holds are added as a run of the batch's own, the others are
lines that a larger document has already.  Runs are compacted by levels.  At
the end the documents of a line are its document count in its own run and
those of the batches that repeated it; a line of enough documents goes
everywhere but in the largest one.

A line's key is the line without white space at its ends and with A-Z in lower
case; it is known by two 64-bit hashes of different seeds, and counted once a
document however often it stands there.

Answers to odd rows: a null text is empty and has one empty line; a null
doc_id counts as one document below all others; rows that repeat a doc_id are
lines of that one document and each stays a row; a repeated line of the
largest document stays as often as it stands there; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

import string

from pyspark.sql import functions as F

from kinetable.llm.base import query, table, written
from kinetable.llm.sorted_runs import SortedRuns, range_cuts

#: Fixed values of the contract: the white space stripped at both ends, shortest key, fewest documents.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Batches of a whole table, and runs of a level before they are compacted.
BATCHES = 4
FAN = 3
#: Key hashes with at least this share of all lines are matched by broadcast; there are at most 1024 of them.
HOT_SHARE = 1024
NO_ID = -(1 << 63)


def line_key(line):
    """What makes two lines the same."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def named(docs):
    """(doc_id, doc, mark, text): the id, the id without null, a hash of the text, the text without null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def line_rows(rows, least_chars):
    """(doc, mark, pos, h1, h2): every line with a key of at least ``least_chars`` code points."""
    lines = rows.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def batch_number(cuts):
    """Batches by falling id: 0 for the ids from the last cut on."""
    number = F.lit(len(cuts))
    for i, cut in enumerate(cuts):
        number = F.when(F.col("doc") >= cut, len(cuts) - 1 - i).otherwise(number)
    return number


def key_counts(lines):
    """(h1, h2, n_docs, n_lines, top) of a batch's lines; both sums are partial before they are shuffled."""
    in_doc = lines.groupBy("h1", "h2", "doc").agg(F.count(F.lit(1)).alias("n"))
    return in_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc").alias("top"))


def repeated_keys(lines, n_batches, least_docs, fan):
    """(h1, h2, n_lines, top) of the keys of at least ``least_docs`` documents; ``lines`` has a ``batch``."""
    runs = SortedRuns(lines.sparkSession, ["h1", "h2"], fan)
    repeats = [runs.add(key_counts(lines.where(F.col("batch") == b))) for b in range(n_batches)]
    whole = runs.together([*runs.names(), *repeats])
    found = whole.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.max("top").alias("top"))
    often = written(found.where(F.col("n_docs") >= least_docs).drop("n_docs"), "often")
    for name in list(runs.paths):
        runs.forget(name)
    return often


def lines_to_drop(lines, often):
    """(doc, mark, pos) of the lines that go.

    Keys with 1/1024 of all dropped or kept repeats (at most 1024 of them)
    meet their lines by broadcast, so no task gets the lines of a hot key; the
    rest by a shuffle on the key.
    """
    total = often.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.broadcast(often.where(F.col("n_lines") * HOT_SHARE >= F.lit(total)))
    cold = often.where(F.col("n_lines") * HOT_SHARE < F.lit(total))
    same = ["h1", "h2"]
    first = lines.join(hot, same)
    rest = lines.join(hot.select(*same), same, "left_anti").join(cold, same)
    return first.unionByName(rest).where(F.col("doc") != F.col("top")).select("doc", "mark", "pos")


def kept_text(text, dropped):
    """The text without the lines at the ``dropped`` places, in one pass over its lines."""
    kept = F.transform(
        F.array(F.split(text, "\n")),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda at: F.get(lines, at)), "\n"
        ),
    )
    return F.when(dropped.isNull(), text).otherwise(F.get(kept, F.lit(0)))


def line_dedup(docs, least_chars=LEAST_CHARS, least_docs=LEAST_DOCS, batches=BATCHES, fan=FAN):
    """Documents (doc_id, text) with ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay.

    Lines whose key has at least ``least_chars`` code points and stands in at
    least ``least_docs`` documents go from all documents but the one of the
    largest id.
    """
    rows = named(docs)
    cuts = range_cuts(rows.select("doc"), "doc", batches)
    lines = written(line_rows(rows, least_chars).withColumn("batch", batch_number(cuts)), "lines", by="batch")
    often = repeated_keys(lines, len(cuts) + 1, least_docs, fan)
    gone = lines_to_drop(lines, often).groupBy("doc", "mark").agg(F.collect_set("pos").alias("dropped"))
    joined = rows.join(gone, ["doc", "mark"], "left")
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        kept_text(F.col("text"), F.col("dropped")).alias("kept"),
    )


TRIMMED = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(
    "op13_line_dedup",
    f"""with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
    lines as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from texts),
    keyed as (select *, translate({TRIMMED}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as k from lines),
    often as (select k, max(doc_id) as top from keyed where length(k) >= {LEAST_CHARS}
      group by k having count(distinct doc_id) >= {LEAST_DOCS}),
    marked as (select keyed.*, top is not null and doc_id <> top as gone from keyed left join often using (k))
    select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
    from marked group by doc_id""",
)
def op13_line_dedup(spark, folder):
    kept = line_dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
