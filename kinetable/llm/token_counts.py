"""Token counts at every prefix of a text, by dynamic programming over its words.

The tokens of a prefix are the tokens of a shorter prefix and one last token;
the last one is the only piece that ends there and that the model keeps apart
from the token before it.  So one pass over the characters of a word gives
the last token and the token count of each of its prefixes.  A text's counts
are the running sum over its words (segments of blanks and a word, which
tokens never cross), and truncation to a budget or the count of any prefix is
a look-up, without encoding again.
"""

from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.llm.base import query, table
from kinetable.llm.pieces import BLANK, Kept, default_model, pieces, segments

#: Tokens a document may have before it counts as over the limit.
LIMIT = 4096
#: Pairs of pieces whose fate a task keeps.
KEPT_PAIRS = 500_000


class PrefixCounter:
    """Token counts of the prefixes of segments under one model.

    ``totals`` and ``tables`` keep the last count and all counts of the
    segments met so far, ``apart`` whether two neighbouring pieces stay as
    they are.  All start anew when full; that changes no result.
    """

    def __init__(self, model):
        self.model = pieces(model)
        self.totals, self.tables, self.apart = {}, Kept(4), {}
        self.breaker = next(c for c in "\n\x01\x02" if c not in self.model.alphabet)
        self.lead = len(self.model.processor.encode(self.breaker))
        self.none = self.model.processor.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        for text, piece in self.model.ids.items():
            self.automaton.add_word(text, (len(text), piece))
        self.automaton.make_automaton()

    def stays_apart(self, left, right):
        """Whether the model leaves two neighbouring pieces (or one after nothing) as they are."""
        p = self.model
        own = [right] if left == self.none else [left, right]
        text = "".join(p.texts[i] for i in own).replace(BLANK, " ")
        return p.processor.encode(self.breaker + text)[self.lead :] == own

    def know(self, found):
        """Tables of those segments that are too long to keep; all others are kept from now on."""
        new, long = self.tables.missing(found)
        if not self.tables:
            self.totals.clear()
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        for segment in new:
            counts = self.tables[segment] = self.programmed(segment)
            self.totals[segment] = counts[-1]
        return {segment: self.programmed(segment) for segment in long}

    def total(self, found):
        """Tokens of all segments together."""
        own = self.know(found)
        if own:
            return sum(own[s][-1] if s in own else self.totals[s] for s in found)
        return sum(map(self.totals.__getitem__, found))

    def programmed(self, segment):
        """Token counts of the segment's prefixes of 1, 2, ... characters."""
        apart, size = self.apart, self.none + 1
        text = segment.replace(" ", BLANK)
        last, counts = [self.none] * (len(text) + 1), [0] * (len(text) + 1)
        done = 0
        for at, (length, piece) in self.automaton.iter(text):
            while done < at:  # characters of no piece: byte pieces, and nothing merges across them
                done += 1
                counts[done] = counts[done - 1] + len(text[done - 1].encode())
            if done > at:
                continue
            before = last[at + 1 - length]
            fits = apart.get(before * size + piece)
            if fits is None:
                fits = apart[before * size + piece] = self.stays_apart(before, piece)
            if fits:
                done = at + 1
                last[done] = piece
                counts[done] = counts[done - length] + 1
        while done < len(text):
            done += 1
            counts[done] = counts[done - 1] + len(text[done - 1].encode())
        del counts[0]
        return array("i", counts)


@lru_cache(maxsize=2)
def counter(model):
    return PrefixCounter(model)


def plain_segments(text):
    return segments((text or "").replace(BLANK, " "))  # to the model both are blanks


class PrefixTable:
    """The stored counts of one text: running sums at its segments and the segments' own counts."""

    def __init__(self, text, model):
        own = counter(model)
        found = plain_segments(text)
        long = own.know(found)
        self.parts = [long[s] if s in long else own.tables[s] for s in found]
        self.lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.tokens = np.cumsum(np.fromiter((p[-1] for p in self.parts), dtype=np.int64, count=len(found)))

    def total(self):
        return int(self.tokens[-1]) if len(self.tokens) else 0

    def at(self, characters):
        """Token count of the text's first ``characters`` characters."""
        if characters <= 0 or not self.parts:
            return 0
        ends = np.cumsum(self.lengths) - 1  # without the blank before the text
        part = min(int(np.searchsorted(ends, characters)), len(ends) - 1)
        before = int(self.tokens[part - 1]) if part else 0
        inside = min(characters, int(ends[-1])) - (int(ends[part - 1]) if part else -1)
        return before + int(self.parts[part][inside - 1])

    def cut(self, budget):
        """Characters of the longest prefix of at most ``budget`` tokens.

        The count of a prefix may fall as characters are added, so the search
        goes back from the first segment whose running sum is beyond what a
        prefix can still have, never from the text's start.
        """
        if self.total() <= budget:
            return max(0, int(self.lengths.sum()) - 1)
        ends = np.cumsum(self.lengths)
        for part in range(min(int(np.searchsorted(self.tokens, budget, side="right")), len(self.parts) - 1), -1, -1):
            before = int(self.tokens[part - 1]) if part else 0
            fits = np.flatnonzero(np.asarray(self.parts[part]) + before <= budget)
            if len(fits):
                start = int(ends[part - 1]) if part else 0
                return max(0, start + int(fits[-1]))
        return 0

    def all_counts(self):
        """The count at every prefix of 0, 1, 2, ... characters."""
        before = np.concatenate(([0], self.tokens[:-1])) if self.parts else []
        whole = [np.asarray(c) + b for c, b in zip(self.parts, before)]
        return np.concatenate([[0], *whole])[[0, *range(2, int(self.lengths.sum()) + 1)]] if self.parts else np.zeros(1, int)


def token_counts(docs, model, limit=LIMIT):
    """Documents (doc_id, text) with n_bytes, n_tokens, over_limit and cut_chars.

    ``n_tokens`` is the exact number of tokens of the whole text under the
    SentencePiece BPE model (bytes of its file); ``cut_chars`` the characters
    of the longest prefix within ``limit``.  A null or empty text has no bytes
    and no tokens.  Repeated rows and null ids give rows of their own; other
    columns are ignored.
    """

    def run(batches):
        for batch in batches:
            kinds = ([], [], [])
            for text in batch.column(1):
                text = text.as_py() or ""
                total = counter(model).total(plain_segments(text))
                kinds[0].append(len(text.encode()))
                kinds[1].append(total)
                kinds[2].append(len(text) if total <= limit else PrefixTable(text, model).cut(limit))
            n_bytes, n_tokens, cut = (pa.array(k, pa.int64()) for k in kinds)
            over = pa.array([n > limit for n in kinds[1]], pa.bool_())
            yield pa.record_batch([batch.column(0), n_bytes, n_tokens, over, cut], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(docs, model):
    """Documents with ``counts``: the token count of every prefix, from none to all characters.

    ``counts[i]`` answers any budget or truncation question about the first
    ``i`` characters.  A null text is empty and has the one count 0.
    """

    def run(batches):
        for batch in batches:
            counts = [PrefixTable(t.as_py(), model).all_counts() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, counts array<int>")


@query("op3_token_counts")
def op3_token_counts(spark, folder):
    return token_counts(table(spark, folder, "documents"), default_model())
