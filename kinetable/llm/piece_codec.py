"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton of all pieces runs over a segment once.  At every position its
output links name the pieces that end there, and each of them relaxes the
best score of that position.  A character that no piece covers is written as
its byte pieces, at a price below every piece, so every text can be encoded
and decoding gives back the same text.
"""

from array import array
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from kinetable.llm.base import STEP_BYTES, query, table
from kinetable.llm.pieces import BLANK, Kept, default_model, pieces, segments


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model):
        self.model = pieces(model)
        self.unknown = min(self.model.scores[i] for i in self.model.ids.values() if self.model.scores[i] > -1e8) - 10.0
        self.automaton = ahocorasick.Automaton()
        for text, piece in self.model.ids.items():
            self.automaton.add_word(text, (len(text), self.model.scores[piece], piece))
        self.automaton.make_automaton()
        self.kept = Kept(4)
        # Stands for a blank character of the text itself, which no piece covers.
        self.literal = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in self.model.alphabet)
        values = [t.replace(BLANK, " ").encode() for t in self.model.texts]
        for byte, i in self.model.bytes.items():
            values[i] = bytes([byte])
        self.values = pa.array(values, pa.large_binary())

    def encoded_segment(self, segment):
        """Piece ids of the best segmentation; of equal scores the one whose last piece is longest."""
        text = segment.replace(BLANK, self.literal).replace(" ", BLANK)
        n = len(text)
        best = [0.0] + [None] * n
        back = [None] * (n + 1)
        done = 0
        for last, (length, score, piece) in self.automaton.iter(text):
            end = last + 1
            while done < last:  # positions that no piece reaches
                done += 1
                self.bytes_to(best, back, done)
            start = end - length
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end] = total
                back[end] = (start, piece)
        while done < n:
            done += 1
            self.bytes_to(best, back, done)
        ids, end = [], n
        while end:
            start, piece = back[end]
            if piece is None:
                ids.extend(self.model.bytes[b] for b in reversed(segment[start].encode()))
            else:
                ids.append(piece)
            end = start
        return array("i", reversed(ids))

    def bytes_to(self, best, back, end):
        """Relax a position by the byte pieces of its last character, if no piece ends there."""
        if best[end] is None:
            best[end] = best[end - 1] + self.unknown
            back[end] = (end - 1, None)

    def encode(self, text):
        """The ids of a text, as the bytes of 32-bit integers of each segment are kept."""
        found, kept = segments(text), self.kept
        new, long = kept.missing(found)
        for segment in new:
            kept[segment] = self.encoded_segment(segment).tobytes()
        if long:
            own = {segment: self.encoded_segment(segment).tobytes() for segment in long}
            parts = [own[segment] if segment in own else kept[segment] for segment in found]
        else:
            parts = map(kept.__getitem__, found)
        ids = array("i")
        ids.frombytes(b"".join(parts))
        return ids

    def joined(self, ids):
        """The bytes that ids stand for, one after the other, and the end of each."""
        taken = self.values.take(ids)
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data = taken.buffers()[2] or pa.py_buffer(b"")
        return memoryview(data).cast("B")[int(ends[0]) : int(ends[-1])], ends - ends[0]

    def decode(self, ids):
        """The text of piece ids, without the blank put before its start."""
        return bytes(self.joined(pa.array(ids, pa.int32()))[0]).decode("utf-8", errors="replace")[1:]


@lru_cache(maxsize=2)
def codec(model):
    return Codec(model)


def steps_of(column):
    """Lists of texts, null as empty, of about STEP_BYTES characters each."""
    step, size = [], 0
    for text in column:
        text = text.as_py() or ""
        if step and size + len(text) > STEP_BYTES:
            yield step
            step, size = [], 0
        step.append(text)
        size += len(text)
    if step:
        yield step


def encode_pieces(docs, model, column="text"):
    """Documents (doc_id) with ``ids``, the pieces of their text, and ``n_tokens``.

    A null or empty text has no ids.  Repeated rows and null ids give rows of
    their own; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            at = 0
            for texts in steps_of(batch.column(1)):
                ids = [codec(model).encode(t) for t in texts]
                counts = pa.array([len(i) for i in ids], pa.int64())
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), listed(ids), counts], names=["doc_id", "ids", "n_tokens"])
                at += len(texts)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def listed(ids):
    """Arrow lists of integer arrays, without going through Python numbers."""
    whole = b"".join(i.tobytes() for i in ids)
    values = pa.Array.from_buffers(pa.int32(), len(whole) // 4, [None, pa.py_buffer(whole)])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, ids))], pa.int32()), values)


def decode_pieces(encoded, model):
    """(doc_id, text) of encoded documents; null ids decode to an empty text."""

    def run(batches):
        for batch in batches:
            texts = [codec(model).decode(i.values if i.is_valid else []) for i in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs, model):
    """(doc_id, n_tokens, ids_hash, same): whole texts encoded and decoded again.

    ``ids_hash`` is a 64-bit digest of the ids as 32-bit little-endian
    integers, ``same`` whether decoding gave back the text (null: empty).
    """

    def tripped(own, texts):
        encoded = [own.encode(t) for t in texts]
        lists = listed(encoded)
        data, ends = own.joined(lists.values)
        bounds = ends[lists.offsets.to_numpy()].tolist()
        hashes = [xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63) for ids in encoded]
        same = [data[a:b] == ((" " + t).encode() if t else b"") for t, a, b in zip(texts, bounds[:-1], bounds[1:])]
        return [len(ids) for ids in encoded], hashes, same

    def run(batches):
        own = codec(model)
        for batch in batches:
            at = 0
            for texts in steps_of(batch.column(1)):
                counts, hashes, same = tripped(own, texts)
                columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *columns], names=["doc_id", "n_tokens", "ids_hash", "same"])
                at += len(texts)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_hash long, same boolean")


@query("op9_piece_codec")
def op9_piece_codec(spark, folder):
    return round_trip(table(spark, folder, "documents"), default_model())
