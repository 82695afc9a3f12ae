"""Alignment of two tokenizers' tokens of the same text, by products of incidence matrices.

A text's tokens of model A and of model B are rows of two token-byte incidence
matrices.  Gustavson's row product A·Bᵀ gives the overlap links (and in how
many bytes two tokens overlap); offsets where tokens of both models end cut
the tokens into groups, and the product of the group incidences gives the
links between tokens of one group.

Three passes over compact id columns, the text is encoded once:

1. ``encoded``: the ids of every text under both models, written out;
2. ``pair_counts``: how many documents hold a pair of ids linked, summed in
   the task before it is shuffled;
3. ``alignment``: each document's links against those counts.  The counts go
   to the tasks as one sorted table where they have at most ``LOOKUP_PAIRS``
   rows (a count that is checked); beyond that, documents' pairs are joined with
   them by a shuffle.  Both give the same rows.

Answers to odd rows: a null or empty text, or one whose tokens' bytes do not
join to a space and the text under both models, has no tokens and zeros
everywhere; every row is a document of its own, also with a null or repeated
id; special strings inside a text are plain text; an empty table gives no
rows; other columns are ignored.
"""

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetable.llm import csr
from kinetable.llm.base import STEP_BYTES, query, table, written
from kinetable.llm.pieces import BLANK, default_model

#: Pairs of ids whose counts go to every task as one table: 16 bytes each, 64 MB.
LOOKUP_PAIRS = 4_000_000
#: Pairs that a counting task keeps before it hands its partial counts on.
KEPT_PAIRS = 1_000_000
#: Entries of a product that are made at once.
BLOCK = 2_000_000
#: Characters on which all Unicode tables agree about letters, digits and blanks.
COMMON = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
#: Fixed value: how byte-level BPE splits a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A document's share of the shuffled join spreads a frequent pair over this many keys.
SALTS = 16


def byte_alphabet():
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {chr(b if b in printing else next(others)): b for b in range(256)}


class ByteBpe:
    """Ids and bytes of a byte-level BPE model (the text of its tokenizers file)."""

    def __init__(self, model):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        spec, alphabet = json.loads(model), byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.bytes[i] = text.encode() if text in added else bytes(alphabet[c] for c in text)
        self.fast = self.ranked(spec, {t: i for t, i in vocabulary.items() if t not in added})

    def ranked(self, spec, vocabulary):
        """The same model by rank of its ids, where ids follow the order of the merges; several times as fast."""
        before = spec.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocabulary["".join(m)] for m in merges]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or spec["model"].get("ignore_merges") or order != sorted(set(order)):
            return None
        ranks = {self.bytes[i]: i for i in vocabulary.values()}
        if len(ranks) != len(vocabulary) or any(bytes([b]) not in ranks or ranks[bytes([b])] > order[0] for b in range(256)):
            return None
        return tiktoken.Encoding("aligned", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text):
        """Ids of a text; texts with rarer characters go the library's own way."""
        if self.fast is not None and COMMON.fullmatch(text):
            return np.asarray(self.fast.encode_ordinary(text), dtype=np.int64)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class PieceBpe:
    """Ids and bytes of a SentencePiece model (bytes of its file)."""

    def __init__(self, model):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes = [bytes([int(t[1:-1], 16)]) if p.is_byte(i) else t.replace(BLANK, " ").encode() for i, t in enumerate(texts)]

    def encode(self, texts):
        return [np.asarray(i, dtype=np.int64) for i in self.processor.encode(texts, num_threads=1)]


class Models:
    def __init__(self, a, b):
        self.a, self.b = ByteBpe(a), PieceBpe(b)
        self.values = [pa.array(m.bytes, pa.large_binary()) for m in (self.a, self.b)]
        self.lengths = [np.array([len(v) for v in m.bytes], dtype=np.int64) for m in (self.a, self.b)]
        self.kinds = [np.dtype(np.uint16 if len(n) <= 1 << 16 else np.uint32) for n in self.lengths]
        widest = max(map(len, self.lengths))
        self.sizes = widest, len(self.lengths[1])
        self.texts = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(widest)], pa.large_string())

    def joined(self, which, ids):
        """The bytes of ids, one after the other, and the ends of each."""
        taken = self.values[which].take(pa.array(ids))
        return joined_bytes(taken)


def joined_bytes(taken):
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1]
    return (taken.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])] if len(taken) else pa.py_buffer(b""), offsets - offsets[0]


@lru_cache(maxsize=2)
def models(a, b):
    return Models(a, b)


def starts(counts):
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


# ------------------------------------------------------------------ encoding


def text_steps(column):
    """Lists of texts, null as empty, of about STEP_BYTES each."""
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


def encoded_step(own, texts):
    """Lists of ids under A and B of each text; empty where the bytes do not join to a space and the text."""
    a = [own.a.encode(" " + t) if t else np.zeros(0, np.int64) for t in texts]
    b = own.b.encode(texts)
    fits = []
    sides = [(own.joined(w, np.concatenate(ids)), starts([len(i) for i in ids])) for w, ids in enumerate((a, b))]
    for at, text in enumerate(texts):
        raw = (" " + text).encode() if text else b""
        spans = [(whole, ends[s[at]], ends[s[at + 1]]) for (whole, ends), s in sides]
        fits.append(bool(text) and all(e - f == len(raw) and whole[int(f) : int(e)].to_pybytes() == raw for whole, f, e in spans))
    none = np.zeros(0, np.int64)
    return [i if f else none for i, f in zip(a, fits)], [i if f else none for i, f in zip(b, fits)]


def binary_column(ids, kind):
    whole = np.concatenate(ids).astype(kind) if ids else np.zeros(0, kind)
    offsets = starts([len(i) * kind.itemsize for i in ids]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])


def encoded(docs, model_a, model_b):
    """(doc_id, a, b): the ids of each text as little-endian integers, two bytes each where the vocabulary allows it."""

    def run(batches):
        for batch in batches:
            own, at = models(model_a, model_b), 0
            for texts in text_steps(batch.column(1)):
                sides = encoded_step(own, texts)
                columns = [binary_column(ids, kind) for ids, kind in zip(sides, own.kinds)]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *columns], names=["doc_id", "a", "b"])
                at += len(texts)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, a binary, b binary")


# ------------------------------------------------------------------- aligning


class Aligned:
    """The tokens of some documents side by side: one line of bytes, all documents after one another."""

    def __init__(self, own, a, b):
        self.own = own
        self.counts = [np.array([len(i) for i in side], dtype=np.int64) for side in (a, b)]
        self.firsts = [starts(c) for c in self.counts]
        self.ids = [np.concatenate([*side, np.zeros(0, np.int64)]).astype(np.int64) for side in (a, b)]
        self.lengths = [n[i] for n, i in zip(own.lengths, self.ids)]
        self.ends = [np.cumsum(n) for n in self.lengths]
        self.cuts = np.intersect1d(*self.ends, assume_unique=True)
        self.groups = [np.searchsorted(self.cuts, e) for e in self.ends]
        bounds = starts(np.diff(starts(self.lengths[0])[self.firsts[0]]))
        self.group_firsts = np.searchsorted(self.cuts, bounds[:-1], side="right") if len(self.cuts) else np.zeros(len(a), np.int64)
        self.n_groups = np.diff(np.append(self.group_firsts, len(self.cuts)))

    def links(self, block=BLOCK):
        """(A token, B token, bytes that they share), in blocks: the product of the token-byte incidences."""
        matrix = csr.run_incidence(self.lengths[0])
        return csr.product_blocks(matrix, csr.run_incidence_transposed(self.lengths[1]), block)

    def group_matrices(self):
        a, b = (csr.label_incidence(g, len(self.cuts)) for g in self.groups)
        return a, b.transposed()

    def shared_group_links(self, block=BLOCK):
        """(A token, B token, 1) of tokens of one group, in blocks: the product of the group incidences."""
        return csr.product_blocks(*self.group_matrices(), block)

    def shared_counts(self):
        """How many shared-group links each document has, from the symbolic half of the product."""
        return np.diff(starts(csr.product_widths(*self.group_matrices()))[self.firsts[0]])

    def doc_of(self, a_tokens):
        return np.searchsorted(self.firsts[0], a_tokens, side="right") - 1

    def codes(self, a_tokens, b_tokens):
        """One number for the ids of a link."""
        return self.ids[0][a_tokens] * self.own.sizes[1] + self.ids[1][b_tokens]

    def doc_pairs(self):
        """(document, code, links) of the distinct linked id pairs of every document, in blocks of whole documents or less."""
        space = np.int64(len(self.own.lengths[0])) * self.own.sizes[1]
        whole = [(self.doc_of(a) * space + self.codes(a, b)) for a, b, _ in self.links()]
        keys, n = np.unique(np.concatenate([*whole, np.zeros(0, np.int64)]), return_counts=True)
        return keys // space, keys % space, n

    def group_texts(self):
        """The groups of each document as text: ``a1,a2|b1;a3|b2,b3``."""
        places, kinds = [], []
        for side, other in ((0, 1), (1, 0)):
            mine, theirs = self.groups[side], self.groups[other]
            places.append(np.arange(len(mine)) + np.searchsorted(theirs, mine, side="right" if side else "left"))
            last = np.append(mine[1:] != mine[:-1], True)[: len(mine)]
            kinds.append(np.where(last, 2 if side else 1, 0) * self.own.sizes[0] + self.ids[side])
        order = np.empty(len(places[0]) + len(places[1]), dtype=np.int64)
        order[places[0]], order[places[1]] = kinds
        whole, ends = joined_bytes(self.own.texts.take(pa.array(order)))
        bounds = ends[self.firsts[0] + self.firsts[1]]
        return [memoryview(whole)[int(f) : int(e) - 1] if e > f else memoryview(b"") for f, e in zip(bounds[:-1], bounds[1:])]


def id_lists(column, kind):
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    whole = np.frombuffer(column.buffers()[2], dtype=kind) if column.buffers()[2] else np.zeros(0, kind)
    return [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def aligned_steps(own, batches):
    """(record batch, its ``Aligned``) of rows with about STEP_BYTES ids at most."""
    for batch in batches:
        a, b = (id_lists(batch.column(w + 1), own.kinds[w]) for w in (0, 1))
        sums = starts([len(x) + len(y) for x, y in zip(a, b)])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sums, sums[first] + STEP_BYTES, side="right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first), Aligned(own, a[first:last], b[first:last])
            first = last


def summed(codes, counts):
    """Distinct codes in order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(tokens, model_a, model_b):
    """(code, n, best): documents that hold the id pair linked, and whether no pair of the same A id has more.

    ``code`` is A's id times the size of B's vocabulary plus B's id.
    """
    size = len(models(model_a, model_b).lengths[1])

    def run(batches):
        own, kept, waiting = models(model_a, model_b), (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def merged():
            return summed(*(np.concatenate(x) for x in zip(kept, *waiting)))

        def out():
            return pa.record_batch([pa.array(kept[0]), pa.array(kept[1])], names=["code", "n"])

        for _, aligned in aligned_steps(own, batches):
            _, codes, _ = aligned.doc_pairs()
            waiting.append(summed(codes, np.ones(len(codes), np.int64)))
            if sum(len(c) for c, _ in waiting) > KEPT_PAIRS:
                kept, waiting = merged(), []
                if len(kept[0]) > KEPT_PAIRS:
                    yield out()
                    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept, waiting = merged(), []
        yield out()

    found = tokens.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = written(found, "pairs")
    a_id = F.floor(F.col("code") / F.lit(size)).cast("long")
    most = found.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return written(
        found.withColumn("a_id", a_id).join(most, "a_id").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "counted"
    )


STATIC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string"


def static_columns(batch, aligned, n_links):
    texts = aligned.group_texts()
    digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]
    numbers = [*aligned.counts, aligned.n_groups, n_links, aligned.shared_counts()]
    return [batch.column(0), *[pa.array(np.asarray(n, dtype=np.int64)) for n in numbers], pa.array(digests, pa.string())]


STATIC_NAMES = [c.split(" ")[0] for c in STATIC.split(", ")]


def looked_up(tokens, counts, model_a, model_b):
    """Documents with n_best and count_sum; the counts go to the tasks as one sorted table."""
    rows = counts.orderBy("code").toArrow()
    held = tokens.sparkSession.sparkContext.broadcast(
        (rows.column("code").to_numpy(), rows.column("n").to_numpy(), rows.column("best").to_numpy(zero_copy_only=False))
    )

    def run(batches):
        own = models(model_a, model_b)
        codes, n, best = held.value
        for batch, aligned in aligned_steps(own, batches):
            links, sums, bests = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, _ in aligned.links():
                at = np.searchsorted(codes, aligned.codes(a, b))
                doc = aligned.doc_of(a)
                links += np.bincount(doc, minlength=len(links))
                for out, values in ((sums, n[at]), (bests, best[at].astype(np.int64))):
                    total = starts(values)
                    edge = np.searchsorted(doc, np.arange(len(out) + 1))
                    out += np.diff(total[edge])
            yield pa.record_batch(
                [*static_columns(batch, aligned, links), pa.array(bests), pa.array(sums)], names=[*STATIC_NAMES, "n_best", "count_sum"]
            )

    return tokens.mapInArrow(run, f"{STATIC}, n_best long, count_sum long")


def joined_up(tokens, counts, model_a, model_b):
    """The same by a shuffle: one row for each distinct linked pair of a document, spread by salt."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]

    def pairs(batches):
        own = models(model_a, model_b)
        for batch, aligned in aligned_steps(own, batches):
            doc, codes, n = aligned.doc_pairs()
            own_rows = [batch.column(c).take(pa.array(doc)) for c in ("file", "row")]
            yield pa.record_batch([*own_rows, pa.array(codes), pa.array(n)], names=["file", "row", "code", "links"])

    def fixed(batches):
        own = models(model_a, model_b)
        for batch, aligned in aligned_steps(own, batches):
            n_links = np.zeros(batch.num_rows, np.int64)
            for a, _, _ in aligned.links():
                n_links += np.bincount(aligned.doc_of(a), minlength=len(n_links))
            columns = static_columns(batch, aligned, n_links)
            yield pa.record_batch([batch.column("file"), batch.column("row"), *columns], names=["file", "row", *STATIC_NAMES])

    placed = tokens.select("doc_id", "a", "b", *place)
    salted = placed.mapInArrow(pairs, "file string, row long, code long, links long").withColumn(
        "salt", F.pmod(F.xxhash64("file", "row"), F.lit(SALTS))
    )
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = salted.join(spread, ["code", "salt"])
    sums = met.groupBy("file", "row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")
    )
    whole = placed.mapInArrow(fixed, f"file string, row long, {STATIC}").join(sums, ["file", "row"], "left")
    return whole.select(*STATIC_NAMES, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def alignment(docs, model_a, model_b, lookup_pairs=LOOKUP_PAIRS):
    """Documents (doc_id, text) with the counts of their tokens, groups and links.

    ``n_links`` are all pairs of an A and a B token whose bytes overlap,
    ``n_shared`` all pairs of one group; a pair of ids counts as many documents
    as hold it linked, ``n_best`` are the links whose count no pair of the same
    A id exceeds, ``count_sum`` is the sum over the links, ``groups_sha256``
    the digest of the groups.
    """
    tokens = written(encoded(docs, model_a, model_b), "tokens")
    counts = pair_counts(tokens, model_a, model_b)
    few = counts.count() <= lookup_pairs
    return (looked_up if few else joined_up)(tokens, counts, model_a, model_b)


def link_rows(docs, model_a, model_b, shared=False):
    """One row a link: (doc_id, a_at, b_at, a_id, b_id, n), by overlap or, with ``shared``, by group.

    ``a_at`` and ``b_at`` number the tokens of the text from 0; ``n`` is the
    number of bytes in common (1 for links by group).
    """

    def run(batches):
        own = models(model_a, model_b)
        for batch, aligned in aligned_steps(own, batches):
            for a, b, n in aligned.shared_group_links() if shared else aligned.links():
                doc = aligned.doc_of(a)
                places = [t - f[doc] for t, f in zip((a, b), aligned.firsts)]
                ids = [i[t] for i, t in zip(aligned.ids, (a, b))]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(doc)), *map(pa.array, (*places, *ids, n))],
                    names=["doc_id", "a_at", "b_at", "a_id", "b_id", "n"],
                )

    tokens = encoded(docs, model_a, model_b)
    return tokens.mapInArrow(run, "doc_id long, a_at long, b_at long, a_id long, b_id long, n long")


def default_byte_model():
    """Text of the public byte-level model file that the query uses."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@query("op11_token_alignment")
def op11_token_alignment(spark, folder):
    return alignment(table(spark, folder, "documents"), default_byte_model(), default_model())
