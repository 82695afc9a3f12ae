"""License scans: exact phrases, and notices with a bounded number of edits.

A notice of which up to k characters were edited still holds one of its k + 1
parts unchanged.  So the parts of all notices are searched exactly, in one
Aho-Corasick pass, and only around their hits the regex library verifies the
whole notice with bounded errors and reports where it stands and at what cost.
"""

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from kinetable.llm.base import query, table

#: Phrases of the contract and their labels.  Fixed values.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Short notices searched with edits, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "all rights reserved": "all-rights-reserved",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
}
#: Characters of a notice for each edit that it may have.
CHARACTERS_AN_EDIT = 12

TRANSLATED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text):
    """The words of a text, A-Z lower-cased, with one blank between, before and after them."""
    return b" %b " % b" ".join(text.encode().translate(TRANSLATED).split())


class Scanner:
    """Exact phrases and fuzzy notices over the plain words of texts."""

    def __init__(self, base, notices):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base]
        self.notices = []
        parts = {}
        for phrase, label in notices:
            edits = max(1, len(phrase) // CHARACTERS_AN_EDIT)
            pattern = regex.compile(f"(?:{regex.escape(phrase)}){{e<={edits}}}", regex.BESTMATCH)
            number = len(self.notices)
            self.notices.append((phrase, label, edits, pattern))
            cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                parts.setdefault(phrase[a:b], []).append((number, a, b))
        self.seeds = ahocorasick.Automaton()
        for part, places in parts.items():
            self.seeds.add_word(part, places)
        self.seeds.make_automaton()

    def exact(self, words):
        """(start, end, label) in characters of all places of the exact phrases."""
        found = []
        for phrase, label in self.base:
            at = words.find(phrase)
            while at >= 0:
                found.append((at + 1, at + len(phrase) - 1, label))
                at = words.find(phrase, at + 1)
        return sorted(found)

    def fuzzy(self, words):
        """(start, end, label, edits, allowed) of the notices, best first where they overlap."""
        windows = {}
        for last, places in self.seeds.iter(words):
            for number, a, b in places:
                phrase, _, edits, _ = self.notices[number]
                begin = last + 1 - b
                windows.setdefault(number, []).append((max(0, begin - edits), min(len(words), begin + len(phrase) + edits)))
        found = []
        for number, spans in windows.items():
            phrase, label, edits, pattern = self.notices[number]
            for low, high in merged(sorted(spans)):
                for match in pattern.finditer(words, low, high):
                    found.append((match.start(), match.end(), label, sum(match.fuzzy_counts), edits))
        kept = []
        for item in sorted(found, key=lambda f: (f[3], f[0] - f[1], f)):
            if all(item[1] <= k[0] or item[0] >= k[1] for k in kept):
                kept.append(item)
        return sorted(kept)


def merged(spans):
    """Sorted spans with overlapping ones joined."""
    joined = []
    for low, high in spans:
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(high, joined[-1][1])
        else:
            joined.append([low, high])
    return joined


@lru_cache(maxsize=4)
def scanner(base, notices):
    return Scanner(base, notices)


def scanned(text, base, notices):
    """(number of words, exact places, fuzzy places), places as (first word, last word + 1, label, edits, allowed)."""
    own = scanner(base, notices)
    raw = plain_words(text)
    if raw == b"  ":
        return 0, [], []
    exact = [(raw.count(b" ", 0, a) - 1, raw.count(b" ", 0, b), label, 0, 0) for a, b, label in own.exact(raw)]
    words = raw.decode()
    fuzzy = [
        (max(0, words.count(" ", 0, a + (words[a] == " ")) - 1), words.count(" ", 0, b - (words[b - 1] == " ")), label, edits, allowed)
        for a, b, label, edits, allowed in own.fuzzy(words)
    ]
    return raw.count(b" ") - 1, exact, fuzzy


def scan_licenses(docs, base=tuple(BASE.items()), notices=tuple(NOTICES.items())):
    """Licence phrases of documents (doc_id, text).

    Returns doc_id, n_words, n_base (places of exact phrases), first_word and
    last_word (their least and greatest start, words counted from 0, else
    null), base_labels, labels (with those of the notices found with edits;
    both distinct, sorted and comma-joined, empty without any), score (1 with
    an exact phrase, else 1 less the share of the allowed edits that the best
    notice used up, halved; 0 without any) and ``spans``: all places as
    (first_word, end_word, label, edits).

    Words are A-Z lower-cased runs of letters, digits and non-ASCII
    characters.  A null or empty text has no words.  Repeated rows and null
    ids give rows of their own; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(8)]
            for text in batch.column(1):
                n, exact, fuzzy = scanned(text.as_py() or "", base, notices)
                starts = [p[0] for p in exact]
                own = sorted({p[2] for p in exact})
                best = max([1.0] * bool(exact) + [1 - p[3] / (2 * p[4]) for p in fuzzy], default=0.0)
                spans = [{"first_word": p[0], "end_word": p[1], "label": p[2], "edits": p[3]} for p in sorted(set(exact + fuzzy))]
                row = (n, len(exact), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *(p[2] for p in fuzzy)})), best, spans)
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.record_batch([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, spans array<struct<first_word long, end_word long, label string, edits long>>",
    )


@query("op4_license_scan")
def op4_license_scan(spark, folder):
    return scan_licenses(table(spark, folder, "documents")).drop("spans")
