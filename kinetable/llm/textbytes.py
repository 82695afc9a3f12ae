"""Vectorised words, hashes and shingles over the bytes of many texts at once.

Used inside mapInArrow tasks.  A step holds the texts of a few rows as one
byte array; everything else is array work of the step's size.
"""

import numpy as np
import pyarrow as pa

from kinetable.llm.base import STEP_BYTES

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def lower_table():
    """Byte table that lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def word_table(separators):
    """True for the bytes that belong to words, given the bytes that part them."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of the n-gram contract: everything but white space.
BLANK_PARTED = word_table([0x20, *range(0x09, 0x0E)])
#: Words of letters, digits and all bytes of non-ASCII characters.
ALNUM = word_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mixed(x):
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(batches, column="text"):
    """Record batches cut into (rows, text bytes, offsets) of at most STEP_BYTES where rows allow it.

    ``rows`` is a record batch; null texts are empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, side="right")) - 1
            last = min(max(last, first + 1), len(texts))
            own = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[own[0] : own[-1]], own - own[0]
            first = last
        del texts, data, offsets
        pa.default_memory_pool().release_unused()


def word_spans(data, offsets, table):
    """Starts and ends of all words, and the number of words of each text."""
    inside = table[data]
    starts_of_texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    if len(inside):
        before[starts_of_texts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    if len(inside):
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def powers(n, _kept={}):
    """Powers of STEP and of its inverse modulo 2**64, kept for the longest step so far."""
    if _kept.get("n", 0) < n:
        size = max(n, STEP_BYTES + 1)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        _kept["up"] = np.cumprod(np.full(size, STEP))
        _kept["down"] = np.cumprod(np.full(size, inverse))
        _kept["n"] = size
    return _kept["up"], _kept["down"]


def word_hashes(data, starts, ends, table=LOWER):
    """64-bit hash of each word's bytes, mapped by ``table`` (lower case of A-Z unless given).

    Prefix sums of a polynomial give every word's hash at once; the finaliser
    mixes in the length.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((table.astype(np.uint64) + MIX)[data] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * MIX)


def shingle_hashes(words, counts, size):
    """Hashes of all runs of ``size`` words, with the number of runs of each text.

    A text with fewer words, but at least one, has its whole sequence as its
    only run.
    """
    firsts = np.concatenate(([0], np.cumsum(counts)))
    total = np.zeros(len(words), dtype=np.uint64)
    factors, _ = powers(size)
    for j in range(min(size, len(words))):
        total[: len(words) - j] += words[j:] * factors[j]
    total = mixed(total)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    place = np.arange(len(words)) - np.repeat(firsts[:-1], counts)
    keep = place < np.repeat(runs, counts)
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        value = counts[t : t + 1].astype(np.uint64)
        for j in range(firsts[t], firsts[t + 1]):
            value = mixed(value * STEP + words[j : j + 1])
        total[firsts[t]] = value[0]
    return total[keep], runs


def sorted_sets(values, counts):
    """The distinct values of each text in ascending order, one array a text."""
    firsts = np.concatenate(([0], np.cumsum(counts)))
    return [np.unique(values[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
