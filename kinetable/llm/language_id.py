"""Language identification in two steps: the family, then the languages within it.

Linear support vector machines, one against one, over the shares of hashed
letter trigrams: first between language families, then between the languages
of the predicted family.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.llm import textbytes as tb
from kinetable.llm.base import crc_mod, query, table

#: Families of common languages.  Fixed values.  Other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no is",
    "romance": "fr es it pt ro ca",
    "slavic": "ru uk pl cs sk bg sr hr sl",
    "uralic": "fi hu et",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Buckets of the hashed trigrams.
BUCKETS = 4096
#: Labelled documents of each language that are learnt from, about.
SAMPLE = 400
UNKNOWN = "und"


def letter_table():
    """Bytes as the trigrams see them: letters lower-cased, other ASCII bytes as a blank."""
    values = np.where(np.arange(256) < 128, 32, np.arange(256)).astype(np.uint8)
    for c in range(65, 91):
        values[c] = values[c + 32] = c + 32
    return values


LETTERS = letter_table()


def lowered(data):
    """Bytes with letters of ASCII and Latin-1 lower-cased and other ASCII bytes as blanks."""
    seen = LETTERS[data]
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        seen[after] += 32
    return seen


def trigrams(data, offsets):
    """Bucket of the trigram at each byte (BUCKETS where a text ends or all is blank), and its text's number."""
    seen = lowered(data).astype(np.uint32)
    bucket = np.full(len(seen), BUCKETS, dtype=np.int64)
    if len(seen) > 2:
        code = (seen[:-2] << np.uint32(16)) | (seen[1:-1] << np.uint32(8)) | seen[2:]
        mixed = (code * np.uint32(2654435761)) >> np.uint32(20)
        bucket[:-2] = np.where(code == 0x202020, BUCKETS, mixed)
    ends = offsets[1:]
    for back in (1, 2):
        own = ends - back
        bucket[own[(own >= offsets[:-1])]] = BUCKETS
    return bucket, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shares(docs):
    """(lang, shares): the trigram shares of each document as float32 bytes."""

    def run(batches):
        for rows, data, offsets in tb.steps(batches):
            bucket, row = trigrams(data, offsets)
            values = []
            for t in range(len(offsets) - 1):
                counts = np.bincount(bucket[offsets[t] : offsets[t + 1]], minlength=BUCKETS + 1)[:BUCKETS]
                values.append((counts / max(1, counts.sum())).astype(np.float32).tobytes())
            yield pa.record_batch([rows.column(rows.schema.get_field_index("lang")), pa.array(values, pa.binary())], names=["lang", "shares"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, shares binary")


def machine(values, labels, steps=300, penalty=1e-4):
    """Weights and offset of a linear support vector machine (squared hinge) for labels of -1 and 1."""
    spread = values.std(axis=0) + 1e-4
    scaled = np.concatenate([values / spread, np.ones((len(values), 1), np.float32)], axis=1).astype(np.float64)
    cost = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels < 0).sum()))
    weights = np.zeros(scaled.shape[1])
    speed, look = 1 / (2 * (cost @ (scaled**2).sum(axis=1)) + penalty), weights
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - labels * (scaled @ look))
        slope = -2 * (scaled.T @ (cost * slack * labels)) + penalty * look
        moved = look - speed * slope
        look = moved + (step - 1) / (step + 2) * (moved - weights)
        weights = moved
    return weights[:-1] / spread, weights[-1]


class Model:
    """Machines between families and between the languages of each family."""

    def __init__(self, languages, values):
        self.languages = sorted(set(languages))
        family = [FAMILY_OF.get(code, code) for code in languages]
        self.families = sorted(set(family))
        self.members = {f: [c for c in self.languages if FAMILY_OF.get(c, c) == f] for f in self.families}
        self.pairs, columns, offsets = [], [], []
        groups = [(self.families, np.array(family))] + [(self.members[f], np.array(languages)) for f in self.families]
        for names, labels in groups:
            for a, b in combinations(names, 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                weights, offset = machine(values[rows], np.where(labels[rows] == a, 1.0, -1.0))
                self.pairs.append((a, b))
                columns.append(weights)
                offsets.append(offset)
        self.weights = np.array(columns).reshape(len(self.pairs), BUCKETS)
        self.offsets = np.array(offsets)

    def winners(self, names, margins):
        """Name with the most won pairs for each row, larger margins first among equals; and its confidence."""
        votes = np.zeros((len(names), margins.shape[1]))
        sums = np.zeros_like(votes)
        weakest = np.full_like(votes, np.inf)
        for a, b in combinations(range(len(names)), 2):
            margin = margins[self.pairs.index((names[a], names[b]))]
            votes[a] += margin >= 0
            votes[b] += margin < 0
            for side, own in ((a, margin), (b, -margin)):
                sums[side] += np.clip(own, -1, 1)
                weakest[side] = np.minimum(weakest[side], own)
        best = np.argmax(votes + sums / (4 * len(names)), axis=0)
        return best, 1 / (1 + np.exp(-2 * np.clip(weakest[best, np.arange(margins.shape[1])], -20, 20)))

    def predict(self, margins):
        """(language, score) of each column of margins."""
        family, sure = self.winners(self.families, margins)
        languages, scores = [], np.zeros(margins.shape[1])
        own = {f: self.winners(self.members[f], margins) for f in self.families}
        for row, f in enumerate(family):
            name = self.families[f]
            best, inner = own[name]
            languages.append(self.members[name][best[row]])
            scores[row] = sure[row] * inner[row]
        return languages, scores


def train(labelled, sample=SAMPLE):
    """A model from documents (doc_id, text, lang), about ``sample`` of each language, chosen by a hash of the id."""
    labelled = labelled.where("lang is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(F.col("lang") == code, F.lit(min(1.0, sample / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20))
    rows = [(r["lang"], np.frombuffer(r["shares"], dtype=np.float32)) for r in shares(labelled.where(place < share * (1 << 20))).toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    if not rows:
        return None
    return Model([r[0] for r in rows], np.array([r[1] for r in rows]))


def identify(docs, model):
    """(doc_id, lang_pred, score) of documents (doc_id, text).

    ``und`` and 0 where the text is null or has no letter, or nothing was
    learnt.  Repeated rows and null ids give rows of their own; other columns
    are ignored.
    """

    def run(batches):
        for rows, data, offsets in tb.steps(batches):
            n = len(offsets) - 1
            texts = rows.column(1)
            letters = [bool((t := texts[i].as_py()) and any(c.isalpha() for c in t)) for i in range(n)]
            if model is None:
                languages, scores = [UNKNOWN] * n, np.zeros(n)
            else:
                bucket, row = trigrams(data, offsets)
                counts = np.maximum(1, np.bincount(row[bucket < BUCKETS], minlength=n))
                margins = np.empty((len(model.pairs), n))
                for k in range(len(model.pairs)):
                    weights = np.append(model.weights[k], 0.0)
                    margins[k] = np.bincount(row, weights=weights[bucket], minlength=n) / counts + model.offsets[k]
                languages, scores = model.predict(margins)
            languages = [code if has else UNKNOWN for code, has in zip(languages, letters)]
            yield pa.record_batch([rows.column(0), pa.array(languages, pa.string()), pa.array(np.where(letters, scores, 0.0))], names=["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


@query("op8_language_id")
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(docs, train(docs.where(crc_mod("doc_id", 4) != 2)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
