"""Benchmark decontamination with spaced seeds.

Fixed masks pick some of the word positions of a window and ignore the rest,
so a hash over the picked words survives substitutions at the others.  The
seeds of the benchmark meet those of the documents; around each hit the two
texts are laid side by side and every stretch with few substitutions is
verified word by word.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.llm import textbytes as tb
from kinetable.llm.base import query, table

#: Word positions that a seed looks at (1) and ignores (0).
MASKS = ("1111111", "110110111", "1011011011", "11001110101")
#: A stretch counts from this many words on, or the whole of a shorter item.
LEAST_WORDS = 13
#: Matching words that outweigh one substitution.
WORDS_A_SUBSTITUTION = 4
#: Text bytes of the benchmark that tasks hold at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 32_000_000
#: Bits of the filter in front of the seed look-up.
FILTER_BITS = 22


def word_ids(data, offsets):
    """Hashes of the words (letters, digits and non-ASCII, lower-cased) and the number of each text's."""
    seen = tb.LOWER[data]
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        seen[after] += 32
    starts, ends, counts = tb.word_spans(seen, offsets, tb.ALNUM)
    return tb.word_hashes(seen, starts, ends), counts


def seeds(words, counts, mask):
    """(hash, place) of the mask at every place where it stays within a text."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors, _ = tb.powers(len(picked))
    total = np.zeros(n, dtype=np.uint64)
    for factor, i in zip(factors, picked):
        total += words[i : i + n] * factor
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
    return tb.mixed(total[place] + np.uint64(len(mask))), place


class Benchmark:
    """Words, seeds and a filter over the seeds of a block of benchmark items."""

    def __init__(self, items):
        items = sorted((i, t) for i, t in items if t)
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        self.words, counts = word_ids(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        self.items = np.array([i for i, _ in items], dtype=np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(items)), counts)
        short = sorted({int(c) for c in counts if 0 < c < max(map(len, MASKS))})
        self.tables = []
        for mask in MASKS + tuple("1" * n for n in short):
            value, place = seeds(self.words, counts, mask)
            if mask not in MASKS:  # short items are looked for as a whole
                own = counts[owner[place]] == len(mask)
                value, place = value[own], place[own]
            order = np.argsort(value, kind="stable")
            value, place = value[order], place[order]
            sieve = np.zeros(1 << FILTER_BITS, dtype=bool)
            sieve[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((mask, value, place, owner[place], sieve))

    def overlaps(self, words, counts):
        """(text, item number, first word in the text, first word in the item, words, substitutions) of verified stretches."""
        firsts = np.concatenate(([0], np.cumsum(counts)))
        text_of = np.repeat(np.arange(len(counts)), counts)
        hits = []
        for mask, values, places, owners, sieve in self.tables:
            value, place = seeds(words, counts, mask)
            near = sieve[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            value, place = value[near], place[near]
            low, high = np.searchsorted(values, value), np.searchsorted(values, value, side="right")
            times = high - low
            at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place = np.repeat(place, times)
            hits.append(np.stack([text_of[place], owners[at], place - firsts[text_of[place]] - (places[at] - self.firsts[owners[at]])], axis=1))
        for text, item, shift in np.unique(np.concatenate(hits), axis=0):
            own, other = words[firsts[text] : firsts[text + 1]], self.words[self.firsts[item] : self.firsts[item + 1]]
            first, last = max(0, -shift), min(len(other), len(own) - shift)
            same = own[first + shift : last + shift] == other[first:last]
            least = min(LEAST_WORDS, len(other))
            if (1 + WORDS_A_SUBSTITUTION) * np.count_nonzero(same) <= WORDS_A_SUBSTITUTION * least:
                continue
            for a, b in stretches(same):
                if b - a >= least:
                    yield int(text), int(item), int(first + shift + a), int(first + a), int(b - a), int((~same[a:b]).sum())


def stretches(same):
    """(start, end) of all maximal stretches by matches over weighted substitutions, from left to right.

    These are the best stretch, the best ones on its left and right, and so
    on, found in one pass over the runs of matches.  Of equal ones the first
    and shortest counts.
    """
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -WORDS_A_SUBSTITUTION))))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))).tolist()
    found = []  # (start, end, place of the last earlier one that starts at a lower sum)
    for start, end in zip(edges[::2], edges[1::2]):
        while True:
            lower = len(found) - 1
            while lower >= 0 and sums[found[lower][0]] >= sums[start]:
                lower = found[lower][2]
            if lower < 0 or sums[found[lower][1]] >= sums[end]:
                break
            start = found[lower][0]
            del found[lower:]
        found.append((start, end, lower))
    return [f[:2] for f in found]


def blocks(benchmark):
    """The benchmark's (item_id, text) as Benchmark objects of at most about BLOCK_BYTES, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // BLOCK_BYTES + 1
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Benchmark([tuple(r) for r in own.collect()])


def find_leaks(docs, benchmark):
    """Verified overlaps of documents (doc_id, text) with benchmark items (item_id, text).

    One row for each stretch: doc_id, item_id, doc_word and item_word (where
    it starts, words from 0), n_words and n_substituted.  A stretch has at
    least LEAST_WORDS words, or the whole of a shorter item; an alignment of
    the two texts can have several.  Null and empty texts overlap with nothing.  Repeated rows
    and items give rows of their own; a null doc_id stays null, items without
    an id are left out.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_substituted long"
    found = None
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for rows, data, offsets in tb.steps(batches):
                own = held.value
                overlaps = list(own.overlaps(*word_ids(data, offsets)))
                if overlaps:
                    text, item, *rest = (np.array(c, dtype=np.int64) for c in zip(*overlaps))
                    yield pa.record_batch([rows.column(0).take(pa.array(text)), pa.array(own.items[item])] + [pa.array(c) for c in rest], names=names)

        names = [c.split()[0] for c in schema.split(", ")]
        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs, benchmark):
    """The documents that overlap with no benchmark item; all columns stay as they are."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for rows, data, offsets in tb.steps(batches):
                leaked = np.zeros(rows.num_rows, dtype=bool)
                leaked[[o[0] for o in held.value.overlaps(*word_ids(data, offsets))]] = True
                yield rows.filter(pa.array(~leaked))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op1_decontamination")
def op1_decontamination(spark, folder):
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
