"""Secret scans: fixed patterns, and character Markov models for the rest.

Two first-order Markov models over characters are trained from labelled
samples: random strings (the values that the fixed patterns label as secrets)
and ordinary identifiers (the words of the same texts).  A word long enough to
be a key is a secret if the log-likelihood ratio a character reaches the
threshold.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.llm.base import query, table

#: The fixed patterns.  Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

#: Words that the Markov models judge: long ones of key characters, of at least one digit or inner change of case.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])", re.ASCII)
ORDINARY = re.compile(r"[A-Za-z][A-Za-z0-9_-]{5,}", re.ASCII)
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
PLACE = np.full(128, len(CHARACTERS), dtype=np.int64)  # the last state: the start of a word
PLACE[[ord(c) for c in CHARACTERS]] = np.arange(len(CHARACTERS))
STATES = len(CHARACTERS) + 1
#: Documents that the models are trained on, about; a longer table is sampled by its ids' hash.
TRAINING_DOCUMENTS = 10_000
#: Log-likelihood ratio a character from which a word is a secret.
THRESHOLD = 1.0


def base_spans(text):
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if LONG_HEX.search(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return found


def steps_of(words):
    """Transitions within words (parted by NUL characters) as numbers, each word's start included."""
    states = PLACE[np.minimum(np.frombuffer(words.encode("ascii", "replace"), dtype=np.uint8), 127)]
    before = np.concatenate(([STATES - 1], states[:-1]))
    return (before * STATES + states)[states < STATES - 1]


def transition_counts(docs):
    """(random, step, n) counted over the labelled samples of the documents.

    Values that a fixed pattern found are samples of random strings, words
    outside of all found spans samples of ordinary identifiers.
    """

    def run(batches):
        for batch in batches:
            counts = np.zeros((2, STATES * STATES), dtype=np.int64)
            for text in batch.column(0):
                text = text.as_py() or ""
                spans = base_spans(text)
                values = [ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b] for kind, a, b in spans]
                for a, b in sorted(((s[1], s[2]) for s in spans), reverse=True):
                    text = text[:a] + " " + text[b:]
                for label, words in enumerate((ORDINARY.findall(text), values)):
                    if words:
                        counts[label] += np.bincount(steps_of("\0".join(words)), minlength=STATES * STATES)
            label, step = np.nonzero(counts)
            yield pa.record_batch([pa.array(label.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[label, step])], names=["random", "step", "n"])

    counted = docs.select("text").mapInArrow(run, "random int, step int, n long")
    return counted.groupBy("random", "step").agg(F.sum("n").alias("n"))


def train(docs, sample=TRAINING_DOCUMENTS):
    """Log-likelihood ratio of every transition, random against ordinary.

    Trained on about ``sample`` documents, chosen by a hash of their ids.  The
    table of counts has a fixed size.  Each transition starts from a count of
    one spread over all; without any random sample the characters of keys are
    taken as equally likely.
    """
    total = docs.count()
    if total > sample:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    counts = np.zeros((2, STATES, STATES))
    for row in transition_counts(docs).toLocalIterator():
        counts[row["random"]].flat[row["step"]] = row["n"]
    counts[0] += 0.1
    counts[1] += 1.0
    likely = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (likely[1] - likely[0]).ravel()


def ratio(word, model):
    """Mean log-likelihood ratio of a word's characters."""
    return float(model[steps_of(word)].mean())


def found_spans(text, model, threshold=THRESHOLD):
    """All spans of a text, by start and then kind; (spans, base spans)."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        inner = any(c.isdigit() for c in word) or (word[1:].lower() != word[1:] and word[1:].upper() != word[1:])
        if inner and ratio(word, model) >= threshold and not any(a < m.end() and m.start() < b for _, a, b in base):
            more.append(("random", m.start(), m.end()))

    def order(s):
        return s[1], KINDS.index(s[0])

    return sorted(base + more, key=order), sorted(base, key=order)


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan_secrets(docs, model, threshold=THRESHOLD):
    """Secrets of documents (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the joined
    spans of the fixed patterns) and spans (all, as kind:start:end in code
    points, end exclusive).  The Markov models add spans of kind ``random``
    where no fixed pattern found one.  A null or empty text has none.  Repeated
    rows and null ids give rows of their own; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(5)]
            for text in batch.column(1):
                spans, base = found_spans(text.as_py() or "", model, threshold)
                for kind, column in zip(KINDS, columns):
                    column.append(sum(s[0] == kind for s in base))
                columns[3][-1] = hashlib.sha256(joined(base).encode()).hexdigest()
                columns[4].append(joined(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs, model, mark="[SECRET]", threshold=THRESHOLD):
    """Documents with every found span of ``text`` replaced by ``mark``; n_chars, where there, follows.

    All rows, columns and texts without secrets stay as they are; nulls stay null.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    spans, _ = found_spans(text, model, threshold)
                    low = len(text)
                    for _, a, b in sorted(spans, key=lambda s: -s[2]):
                        if a >= low:
                            continue
                        text = text[:a] + mark + text[min(b, low) :]
                        low = a
                texts.append(text)
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    cleaned = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


@query("op5_secret_scan")
def op5_secret_scan(spark, folder):
    docs = table(spark, folder, "documents")
    return scan_secrets(docs, train(docs.select("doc_id", "text")))
