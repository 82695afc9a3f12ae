"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

One dictionary is trained on toxic text and one on ordinary text.  A window is
a word between two fixed pads that both dictionaries hold, so that its
compressed length shows to the byte how well a dictionary knows the word.
Longer windows bury a short insult in the noise of its neighbours (measured:
area under the curve 0.60 to 0.70 for windows of 32 to 64 bytes).  The toxic
dictionary is trained on what sets toxic text apart: words that are much more
frequent there, by a test over all words, in several documents and beside
several other words; it is as large as these words need.  A second half of the
labelled sample calibrates which pairs of lengths speak for toxicity; a
document scores as its most telling window.
"""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from kinetable.llm.base import crc_mod, query, table

LEAD = b"0123456789abcdefghijklmnopqrstuvwxyz-ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TAIL = b"<~{[(;:|?>)]}~@#$%&*+=_!^>"
WORD = re.compile(r"[^\W\d_]+")
LEVEL = 9
#: Bytes of the ordinary dictionary, and of the trained part of the toxic one for a few words.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 1024
#: Bytes of a sample of the trainer; longer texts are several samples.
SAMPLE_BYTES = 4000
#: Labelled documents of each label that are learnt from, about.
SAMPLE = 3000
#: A word sets toxic text apart from this ratio of document shares on, in so many toxic documents and behind so many other words.
RATIO, SUPPORT = 8, 3
#: Share of words that may be taken by chance among those taken (Benjamini-Hochberg).
FALSE_SHARE = 0.05
#: Bytes that a window may cost beyond an empty one to count as known to the toxic dictionary, if none of its own words costs more.
KNOWN_BYTES = 6
#: Weight of the base rate, in documents, when a pair of lengths is calibrated.
PRIOR = 4
#: Words whose lengths a task keeps.
KEPT_WORDS = 200_000


def words_of(text):
    return WORD.findall(text.lower())


def trained(samples, size):
    """Content of a zstandard dictionary trained on samples.

    Where there are too few samples for the trainer, their own text is the content.
    """
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def chunks(words):
    """The words, joined, in samples of about SAMPLE_BYTES."""
    part, held = [], 0
    for word in words:
        raw = word.encode()
        if part and held + len(raw) + 1 > SAMPLE_BYTES:
            yield b" ".join(part)
            part, held = [], 0
        part.append(raw)
        held += len(raw) + 1
    if part:
        yield b" ".join(part)


def chance(n, known, share):
    """Probability of at least ``n`` toxic ones among ``n + known`` documents that are toxic with probability ``share``."""
    total = n + known
    logs = math.lgamma(total + 1) + np.array([i * math.log(share) + (total - i) * math.log1p(-share) - math.lgamma(i + 1) - math.lgamma(total - i + 1) for i in range(n, total + 1)])
    return float(np.exp(logs).sum())


def telling_words(toxic, ordinary):
    """Words that set toxic text apart, the surest last, from the word lists of labelled documents.

    Near copies repeat a word behind the same one, so a word is tested as if
    it stood in no more documents than it has different words before it.
    """
    known = Counter(w for words in ordinary for w in set(words))
    seen = Counter(w for words in toxic for w in set(words))
    beside = defaultdict(set)
    for words in toxic:
        for before, word in zip(["", *words], words):
            if len(beside[word]) < 1000:
                beside[word].add(before)
    support = {w: min(n, len(beside[w])) for w, n in seen.items()}
    tested = [w for w, n in support.items() if n >= SUPPORT]
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    if not 0 < share < 1:
        return []
    above = [w for w in tested if seen[w] / len(toxic) >= RATIO * (known[w] + 0.5) / len(ordinary)]
    odds = sorted((chance(support[w], known[w], share), w) for w in above)
    passed = [i for i, (p, _) in enumerate(odds) if p <= FALSE_SHARE * (i + 1) / len(tested)]
    return [w for _, w in reversed(odds[: passed[-1] + 1])] if passed else []


def dictionaries(toxic, ordinary):
    """(toxic content, ordinary content, words of the first) from the word lists of labelled documents.

    The trainer chooses what it likes; words of the toxic dictionary that it left out stand behind its choice.
    """
    telling = telling_words(toxic, ordinary)
    apart = set(telling)
    marked = [c for words in toxic for c in chunks(dict.fromkeys(w for w in words if w in apart))]
    plain = [c for words in ordinary for c in chunks(dict.fromkeys(words))]
    size = max(TOXIC_BYTES, 2 * sum(len(w.encode()) + 1 for w in telling))
    content = b" " + trained(marked, size) + b" "
    left = [w for w in telling if b" " + w.encode() + b" " not in content]
    pads = TAIL + LEAD
    return content + b" ".join(w.encode() for w in left) + b" " + pads, trained(plain, ORDINARY_BYTES) + pads, telling


class Windows:
    """Compressed lengths of word windows under both dictionaries."""

    def __init__(self, contents, telling):
        self.compressors = []
        for content in contents:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.empty = [len(c.compress(LEAD + b"  " + TAIL)) for c in self.compressors]
        self.kept = {}
        self.known = max([KNOWN_BYTES, *(self.cost(0, word) for word in telling)])

    def cost(self, which, word):
        """Bytes that a word's window takes beyond an empty one."""
        return len(self.compressors[which].compress(LEAD + b" " + word.encode() + b" " + TAIL)) - self.empty[which]

    def lengths(self, word):
        """(bytes beyond an empty window, bytes saved against the ordinary dictionary), or None if unknown to the toxic one."""
        cost = self.cost(0, word)
        if cost > self.known:
            return None
        return cost, min(12, self.cost(1, word) - cost)

    def cells(self, words):
        """The distinct pairs of lengths of a text's words."""
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        found = set()
        for word in set(words):
            if word not in kept:
                kept[word] = self.lengths(word)
            found.add(kept[word])
        found.discard(None)
        return found


def train(docs, labels, sample=SAMPLE):
    """The model (dictionary contents, words of the toxic one, probability of each pair of lengths, base rate).

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  About ``sample``
    labels of each kind are chosen by a hash of their ids: a bound on what is
    sent to the tasks and on what the driver holds.  One half trains the
    dictionaries, the other calibrates.
    """
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, sample / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20))
    few = labels.where(place < share * (1 << 20)).select("doc_id", "toxic", F.pmod(place, F.lit(2)).alias("half"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("toxic", "half", F.coalesce("text", F.lit("")).alias("text"))
    halves = {(t, h): [] for t in (0, 1) for h in (0, 1)}
    for row in chosen.orderBy(F.xxhash64("text")).toLocalIterator():
        halves[row["toxic"], row["half"]].append(words_of(row["text"]))
    *contents, telling = dictionaries(halves[1, 0], halves[0, 0])
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.5
    # Each label is sampled by its own share; its documents stand for all of it.
    weights = [counts.get(t, 0) / max(1, len(halves[t, 0]) + len(halves[t, 1])) for t in (0, 1)]
    scale = min([w for w in weights if w] or [1.0])
    windows, seen = Windows(contents, telling), defaultdict(lambda: [0.0, 0.0])
    for toxic in (0, 1):
        for words in halves[toxic, 1]:
            for cell in windows.cells(words):
                seen[cell][toxic] += weights[toxic] / scale
    likely = {cell: (n[1] + PRIOR * base) / (n[0] + n[1] + PRIOR) for cell, n in seen.items()}
    return contents, telling, likely, base


def score_toxicity(docs, model):
    """(doc_id, score, predicted) of documents (doc_id, text).

    The score is the calibrated probability of the text's most telling window;
    a null text, or one without words, scores below the base rate, like one
    whose windows say nothing.  ``predicted`` is 1 from 0.5 on.  Repeated rows
    and null ids give rows of their own; other columns are ignored.
    """
    contents, telling, likely, base = model
    silent = min(0.499, base / 2)
    kept = {}

    def run(batches):
        windows = kept.setdefault("windows", Windows(contents, telling))
        for batch in batches:
            scores = np.array([max([likely.get(c, 0.0) for c in windows.cells(words_of(t.as_py() or ""))] + [silent]) for t in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


@query("op10_toxicity")
def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    scored = score_toxicity(docs, train(docs, labels.where(crc_mod("doc_id", 5) != 0)))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
