"""Line deduplication, token alignment and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetable.llm import csr, line_dedup, prefix_trie, token_alignment
from kinetable.llm.pieces import default_model
from kinetable.llm.spill_queue import SpillingQueue

DOCS = "doc_id long, text string, lang string, pos int, h1 long, doc long, mark long, batch int, a binary, code long"
CLASH = ("en", 3, 1, 2, 3, 4, b"x", 5)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], DOCS).repartition(parts)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ op13


def line_corpus():
    rng = random.Random(3)
    common = [f"a line that many documents share, number {i}" for i in range(12)]
    rows = []
    for i in range(60):
        lines = [f"own line of document {i} with number {j} in it" for j in range(rng.randrange(4))]
        lines += rng.choices(common, k=rng.randrange(5)) + ["the line that stands everywhere in here"]
        lines += ["short", "x" * 19, "y" * 20, ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(f"{rng.choice(['', ' ', chr(9), chr(11)])}{x.upper() if rng.random() < 0.3 else x}{rng.choice(['', '  ', chr(13)])}" for x in lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "the line that stands everywhere in here\n" * 500 + "end"), (104, "ÄÖÜ" * 7), (105, "äöü" * 7)]
    rows += [(106, "ÄÖÜ" * 7), (107, "ÄÖÜ" * 7 + "\nthe line that stands everywhere in here"), (108, "z" * 300_000), (None, "the line that stands everywhere in here"), (None, "y" * 20)]
    return rows + [rows[5], (7, "another text of one id\nthe line that stands everywhere in here")]


def expected_lines(rows, least_chars=20, least_docs=3):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(float("-inf") if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = float("-inf") if i is None else i
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (4, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fan):
    rows = line_corpus()
    out = line_dedup.line_dedup(frame(spark, rows), batches=batches, fan=fan)
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()]
    assert order(found) == order(expected_lines(rows))


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


def test_line_dedup_stays_in_the_jvm(spark, folder):
    plan = line_dedup.op13_line_dedup(spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ op11


ODD = [
    None, "", " ", "  two  blanks ", "a", "don't stop", "tab\tand\nline\r\n end", "<|endoftext|> and <s> </s> <unk> <0x41>", "blank ▁ char", "é́ 日本語 🙂🙂 ​",
    "\x00 nul", "nbsp x\u0085y", "１２ ½ ª º", "x" * 3000, "ab" * 20_000, "word " * 5000, "¡hola! ¿qué tal? ñandú",
]


def models_by_library():
    a = Tokenizer.from_str(token_alignment.default_byte_model())
    a.encode_special_tokens = True
    alphabet = token_alignment.byte_alphabet()
    assert len(alphabet) == 256 and sorted(alphabet.values()) == list(range(256))
    b = sentencepiece.SentencePieceProcessor(model_proto=default_model())

    def a_bytes(i):
        return bytes(alphabet[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, b.encode, a_bytes, b_bytes


def brute_alignment(rows):
    encode_a, encode_b, a_bytes, b_bytes = models_by_library()
    docs, counts = [], Counter()
    for i, text in rows:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        parts = [[a_bytes(x) for x in a], [b_bytes(x) for x in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            a, b, parts = [], [], [[], []]
        ends = [np.cumsum([len(p) for p in side]).tolist() for side in parts]
        links, j = [], 0
        for k, end in enumerate(ends[0]):
            start = end - len(parts[0][k])
            while j and ends[1][j - 1] > start:
                j -= 1
            while j < len(b) and ends[1][j] <= start:
                j += 1
            while j < len(b) and ends[1][j] - len(parts[1][j]) < end:
                links.append((a[k], b[j]))
                j += 1
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for cut in cuts:
            side = []
            for w, ids in enumerate((a, b)):
                last = ends[w].index(cut, at[w]) + 1
                side.append(ids[at[w] : last])
                at[w] = last
            groups.append(side)
        counts.update(set(links))
        docs.append((i, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((i, n_a, n_b, len(groups), len(links), shared, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest(text) if text else ""))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256")


def alignment_rows(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = list(enumerate(ODD + texts))
    return rows + [rows[5], (None, "no id"), (rows[20][0], "other text of one id")]


@pytest.mark.parametrize("lookup", [token_alignment.LOOKUP_PAIRS, 0])
def test_alignment_equals_brute_force(spark, folder, lookup):
    rows = alignment_rows(spark, folder)
    out = token_alignment.alignment(frame(spark, rows), token_alignment.default_byte_model(), default_model(), lookup)
    found = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
    assert order(found) == order(brute_alignment(rows))


def test_alignment_of_nothing(spark):
    for lookup in (10, -1):
        assert token_alignment.alignment(frame(spark, []), token_alignment.default_byte_model(), default_model(), lookup).collect() == []


def test_small_blocks_give_the_same_links():
    own = token_alignment.models(token_alignment.default_byte_model(), default_model())
    a, b = token_alignment.encoded_step(own, ["some wordings here", "", "日本語 ok", "end"])
    aligned = token_alignment.Aligned(own, a, b)
    whole = [np.concatenate(x).tolist() for x in zip(*aligned.links())]
    assert whole == [np.concatenate(x).tolist() for x in zip(*aligned.links(block=3))]
    shared = [tuple(x) for block in aligned.shared_group_links(block=4) for x in zip(*block)]
    assert len(shared) == aligned.shared_counts().sum()
    assert {(x, y) for x, y in zip(*whole[:2])} <= {(x, y) for x, y, _ in shared}
    assert sum(whole[2]) == sum(len(f" {t}".encode()) for t in ["some wordings here", "日本語 ok", "end"])


def test_product_equals_dense():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, y = (rng.random((rng.integers(1, 9), 7)) < 0.4 for _ in range(2))
        made = [csr.Csr(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1], 7) for m in (x, y)]
        rows, columns, values = csr.gustavson(made[0], made[1].transposed())
        dense = np.zeros((len(x), len(y)), int)
        dense[rows, columns] = values
        assert (dense == x.astype(int) @ y.T.astype(int)).all()


def test_fast_encoder_equals_the_library():
    own = token_alignment.models(token_alignment.default_byte_model(), default_model()).a
    assert own.fast is not None
    rng = random.Random(9)
    alphabet = "abcXYZ  \t\n\r'’.,;-12é߯ÿĀɏ"
    for _ in range(2000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ op12


def talks():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 90), 203, 204, 2001]:
        if c % 17 == 3:
            continue
        turns = [(t, "user" if t % 2 == 0 else "assistant", f"text {rng.randrange(3)} é") for t in range(rng.randrange(1, 14))]
        if c % 10 < 5:
            turns[0] = (0, "user", "the very common first turn")
        rows += [(c, *t) for t in turns]
    rows += [(6, None, None, None), (7, None, "user", ""), (8, 40, None, "no role"), (None, 1, "user", "of no conversation")]
    long = [(500, t, "user", f"turn {t}") for t in range(9000)]
    copies = [(c, t, "user", f"turn {t}") for c in (505, 506, 510) for t in range(4100)]
    return rows + long + copies


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    names = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        built = own.get(c - c % 5, [])[:h] + own[c][h:]
        name = 0
        members[name].append(c)
        for turn in built:
            name = names.setdefault((name, turn), len(names) + 1)
            members[name].append(c)
        ends[name].append(c)
    parents = {n: (p, turn) for (p, turn), n in names.items()}
    totals = {n: [0, 0, 0] for n in members}
    depth = {0: 0}
    for n in sorted(parents):
        depth[n] = depth[parents[n][0]] + 1
    for n in sorted(members, reverse=True):
        kids, leaves, saved = totals[n]
        if n:
            saved += (len(members[n]) - 1) * len(parents[n][1][1].encode())
        totals[n] = [kids, leaves or 1, saved]
        if n:
            up = totals[parents[n][0]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + totals[n][1], up[2] + saved
    return [
        (min(members[n]), depth[n], min(members[parents[n][0]]) if n else None, len(members[n]), *totals[n], digest(",".join(map(str, ends[n]))))
        for n in members
    ]


TALKS = "conv_id long, turn long, role string, text string, depth long, a long, pos long, conv string"


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], TALKS).repartition(3)


@pytest.mark.parametrize("share,kept", [(prefix_trie.TOP_SHARE, 100), (40, 7), (3, 1000)])
def test_trie_equals_brute_force(spark, share, kept):
    rows = talks()
    out = prefix_trie.prefix_trie(talk_frame(spark, rows), share, kept).collect()
    assert order(tuple(r) for r in out) == order(brute_trie(rows))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(talk_frame(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(talk_frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_trie_with_a_turnless_conversation(spark):
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "user", "gone too")]
    out = prefix_trie.prefix_trie(talk_frame(spark, rows)).collect()
    assert [tuple(r) for r in out] == [(lone, 0, None, 1, 0, 1, 0, digest(str(lone)))]


def test_queue_sums_and_orders_over_spills():
    rng = random.Random(2)
    for kept in (1, 3, 50):
        queue, want = SpillingQueue(2, kept), defaultdict(lambda: [0, 0])
        for _ in range(400):
            key = (rng.randrange(-9, 0), rng.randrange(30))
            queue.push(key, (1, 5))
            want[key] = [want[key][0] + 1, want[key][1] + 5]
        for key in sorted(want):
            assert queue.first() == key
            assert list(queue.pop(key)) == want[key]
        assert queue.first() is None and queue.pop((0, 0)) is None


def test_queries_equal_their_sql(spark, folder):
    import duckdb

    from kinetable.llm.base import ORACLES, QUERIES

    duck = duckdb.connect()
    for name in ("documents", "conversations"):
        duck.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name in ("op12_prefix_trie", "op13_line_dedup"):
        table = QUERIES[name](spark, folder)
        columns = sorted(table.columns)
        ours = order(tuple(r[c] for c in columns) for r in table.collect())
        theirs = duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
        assert ours == order(theirs)
