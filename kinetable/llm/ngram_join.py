"""N-gram Jaccard join: token-combination prefixes, then exact verification.

The tokens of a document are the hashes of its distinct word n-grams, ordered
by class (rare before frequent) and hash.  Two sets whose Jaccard similarity
reaches the threshold share at least ``1 + m`` tokens of their prefixes once
the prefixes are extended by ``m``.  Rare tokens are indexed singly.  Frequent
ones are dealt into ``m`` classes and indexed as pairs within a class: of
``1 + m`` shared frequent tokens two share a class.  ``m`` belongs to a band of
set sizes, and a document is indexed for its own band and the next one, which
covers all sizes a partner can have.

Equal sets are one node from the start, so copies cost one row a task.  The
verification compares small blocks of like nodes as sparse products.  A node
travels as its compressed text, a fraction of its shingles' size, and its set
is made again where it is compared.  Every pair of blocks that share enough
keys is compared, so every link is verified and counted.  What leaves a pair
of blocks is a forest of its links and each node's number of links, so the
links of large groups of near copies are never spelt out.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetable.llm import textbytes as tb
from kinetable.llm.base import query, table, written
from kinetable.llm.components import connected_components, forest
from kinetable.session import checkpointed

#: Words of a shingle, and the similarity of a link in hundredths.
SHINGLE_WORDS = 5
SIMILARITY = 80
#: A token is frequent from about this share of the documents on.
FREQUENT_SHARE = 1 / 16_000
#: Prefixes are extended by this share of the set.
EXTENSION = 0.03
#: Tokens counted together in a task before the heavy ones are reported.
CHUNK_TOKENS = 2_000_000
#: Nodes compared together.
BLOCK_NODES = 128
#: Ids that may be sent to all executors; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def bands():
    """Lower set sizes of the bands: a partner's size is in the same band or a neighbouring one."""
    lows = [4]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, 5 * (lows[-1] - 1) // 4 + 1))
    return np.array(lows)


LOWS = bands()
CLASSES = np.maximum(1, (LOWS * EXTENSION).astype(int))


def node_of(tokens):
    """Id of a set: a 64-bit digest of its sorted tokens."""
    return np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def sets_of(batches, words, column="text"):
    """(rows, sorted distinct shingles of each row) step by step."""
    for rows, data, offsets in tb.steps(batches, column):
        starts, ends, counts = tb.word_spans(data, offsets, tb.BLANK_PARTED)
        shingles, runs = tb.shingle_hashes(tb.word_hashes(data, starts, ends), counts, words)
        yield rows, tb.sorted_sets(shingles, runs)


def sized_nodes(docs, words, share):
    """One row a document (doc_id, n, node), and rows (token, seen, least) of tokens heavy in a chunk of a task.

    ``least`` is the count from which the chunk reports a token.
    """

    def run(batches):
        known, pending, held = set(), [], 0

        def heavy():
            least = max(2, int(np.ceil(share * len(pending))))
            values, counts = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = counts >= least
            return pa.record_batch(
                [
                    pa.nulls(int(keep.sum()), pa.int64()),
                    pa.nulls(int(keep.sum()), pa.int64()),
                    pa.nulls(int(keep.sum()), pa.int64()),
                    pa.array(values[keep].view(np.int64)),
                    pa.array(counts[keep].astype(np.int64)),
                    pa.array(np.full(int(keep.sum()), least, dtype=np.int64)),
                ],
                names=names,
            )

        names = ["doc_id", "n", "node", "token", "seen", "least"]
        for rows, sets in sets_of(batches, words):
            nodes = [node_of(s) if len(s) else None for s in sets]
            for node, s in zip(nodes, sets):
                if node is not None and node not in known:
                    known.add(node)
                    pending.append(s)
                    held += len(s)
            yield pa.record_batch(
                [rows.column(rows.schema.get_field_index("doc_id")), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())]
                + [pa.nulls(len(sets), pa.int64())] * 3,
                names=names,
            )
            if held >= CHUNK_TOKENS:
                yield heavy()
                pending, held = [], 0
        yield heavy()

    return docs.mapInArrow(run, "doc_id long, n long, node long, token long, seen long, least long")


def frequent_tokens(found, n_documents, share):
    """Sorted array of the frequent tokens.

    A chunk that does not report a token has fewer than its ``least`` of it,
    so ``seen`` plus what silent chunks may hide bounds the true count from
    above.  Kept are the tokens whose bound reaches twice the sum of all
    ``least``: every token beyond that count is kept, and a kept one has at
    least half of it.  So there are at most (shingles a document) / share of
    them, whatever the corpus, and they may be sent to every task.
    """
    total = max(16.0, share * n_documents)
    heavy = (
        found.where("token is not null")
        .groupBy("token")
        .agg(F.sum("seen").alias("seen"), F.sum("least").alias("reported"))
        .where((F.col("seen") >= 16) & (F.col("seen") + F.greatest(F.lit(0.0), total - F.col("reported")) >= 2 * total))
        .select("token")
    )
    return np.sort(heavy.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))


def prefix_keys(tokens, frequent):
    """Index keys of a set and the number of keys a partner shares at least."""
    n = len(tokens)
    band = int(np.searchsorted(LOWS, n, side="right")) - 1
    needed = -(-SIMILARITY * n // 100)
    at = np.searchsorted(frequent, tokens)
    common = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(n, bool)
    rare, often = tokens[~common], tokens[common]
    singles = rare[: min(n, n - needed + 1 + int(CLASSES[band + 1]))]
    keys = [singles]
    inside = 0
    for own in (band, band + 1):
        classes = int(CLASSES[own])
        inside = max(0, min(n, n - needed + 1 + classes) - len(rare))
        if inside < 2:
            continue
        part = often[:inside]
        class_of = (part >> np.uint64(20)) % np.uint64(classes)
        order = np.argsort(class_of, kind="stable")
        part, class_of = part[order], class_of[order]
        ends = np.searchsorted(class_of, class_of, side="right")
        repeats = ends - np.arange(inside) - 1
        first = np.repeat(np.arange(inside), repeats)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        keys.append(tb.mixed(part[first] * tb.STEP + tb.mixed(part[second] + np.uint64(own))))
    return np.concatenate(keys), max(1, 1 + int(CLASSES[band]) - inside)


def index_rows(docs, words, frequent):
    """Rows (key, node, need), once for each distinct set of a task."""

    def run(batches):
        known = set()
        for _, sets in sets_of(batches, words):
            keys, nodes, needs = [], [], []
            for s in sets:
                if len(s) < 4:  # smaller sets link with equal ones only, which are one node
                    continue
                node = node_of(s)
                if node in known:
                    continue
                known.add(node)
                own, need = prefix_keys(s, frequent)
                keys.append(own)
                nodes.append(node)
                needs.append(need)
            if not keys:
                continue
            lengths = [len(k) for k in keys]
            columns = [pa.array(np.concatenate(keys).view(np.int64))]
            columns += [pa.array(np.repeat(np.array(x, dtype=kind), lengths)) for x, kind in ((nodes, np.int64), (needs, np.int32))]
            yield pa.record_batch(columns, names=["key", "node", "need"])

    return docs.mapInArrow(run, "key long, node long, need int")


def least_and_most(rows, column):
    """``rows`` with ``low`` and ``high``, the least and greatest of ``column`` in the row's key."""
    key = Window.partitionBy("key")
    return rows.withColumns({"low": F.min(column).over(key), "high": F.max(column).over(key)})


def shared_members(docs, words, frequent):
    """Index rows (key, node, need, first) of keys that several nodes have; ``first`` is a key's least node."""
    rows = least_and_most(index_rows(docs, words, frequent), "node").where("low < high")
    return written(rows.select("key", "node", "need", F.col("low").alias("first")).distinct(), "members")


def common_counts(left, right):
    """Matrix of the number of common values of two lists of sorted distinct arrays."""
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    values = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*values)
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    places, owners = [], []
    for row, value in zip(rows, values):
        at = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
        hit = common[at] == value if len(common) else np.zeros(len(value), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append(at[hit][order])
        owners.append(row[hit][order])
    for low in range(0, len(common), 4096):
        parts = []
        for place, owner, size in zip(places, owners, counts.shape):
            a, b = np.searchsorted(place, (low, low + 4096))
            part = np.zeros((size, min(4096, len(common) - low)), dtype=np.float32)
            part[owner[a:b], place[a:b] - low] = 1
            parts.append(part)
        counts += parts[0] @ parts[1].T
    return counts.astype(np.int64)


def unpacked_sets(packed, words):
    """Sorted distinct shingles of compressed texts, a few texts at a time."""
    opened = zstandard.ZstdDecompressor()
    batches = (
        pa.record_batch([pa.array([opened.decompress(t.as_py()) for t in packed[low : low + 16]], pa.large_binary()).cast(pa.large_string())], names=["text"])
        for low in range(0, len(packed), 16)
    )
    return [s for _, sets in sets_of(batches, words) for s in sets]


def links_of_blocks(key, rows, words):
    """Links between the two blocks of a pair, counted by node.

    Gives rows (node, other, n): with ``other`` null the documents that
    ``node`` is linked with through this pair of blocks, else a link of those
    that connect exactly what all links connect.
    """
    x, y = (k.as_py() for k in key)
    blocks, nodes, copies = (rows.column(c).to_numpy() for c in ("block", "node", "copies"))
    tokens = unpacked_sets(rows.column("packed"), words)
    left, right = np.flatnonzero(blocks == x), np.flatnonzero(blocks == y)
    found, counted = [], {}
    if len(left) and len(right):
        counts = common_counts([tokens[i] for i in left], [tokens[i] for i in right])
        sizes = np.array([len(t) for t in tokens])
        union = sizes[left][:, None] + sizes[right][None, :] - counts
        near = (100 * counts >= SIMILARITY * union) & (nodes[left][:, None] != nodes[right][None, :])
        counted = dict(zip(nodes[left].tolist(), (near @ copies[right]).tolist()))
        if x != y:
            counted |= dict(zip(nodes[right].tolist(), (copies[left] @ near).tolist()))
        found = [(int(nodes[left[i]]), int(nodes[right[j]])) for i, j in np.argwhere(near)]
    kept = forest(found)
    some = [(node, None, n) for node, n in counted.items() if n]
    columns = list(zip(*some, *((a, b, 0) for a, b in kept))) or [[], [], []]
    return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("node", "other", "n"), columns)})


def sets_of_nodes(docs, found, nodes, words):
    """(node, copies, packed) of the given nodes: the number of their documents and the compressed text of one.

    The ids are sent to all tasks up to BROADCAST_IDS; more meet their texts
    in a shuffled join.
    """
    ids = checkpointed(
        found.where("doc_id is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies"))
    )
    wanted = ids.select("doc_id")
    if ids.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "doc_id", "left_semi")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=6)
        for rows, sets in sets_of(batches, words):
            column = rows.column(rows.schema.get_field_index("text"))
            yield pa.record_batch(
                [
                    rows.column(rows.schema.get_field_index("doc_id")),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([packer.compress((t.as_py() or "").encode()) for t in column], pa.binary()),
                ],
                names=["doc_id", "node", "packed"],
            )

    sets = texts.mapInArrow(run, "doc_id long, node long, packed binary")
    return written(sets.join(ids, ["doc_id", "node"]).dropDuplicates(["node"]).select("node", "copies", "packed"), "sets")


def placed_members(members):
    """Index rows (key, node, need, block) of the nodes with as many shared keys as a partner needs.

    Nodes stand with the node they share most keys with, of those that stand
    first in a key.  A block has about BLOCK_NODES nodes at most.
    """
    shared = members.groupBy("node", "first").agg(F.count("*").alias("c"), F.max("need").alias("q"))
    anchors = checkpointed(
        shared.groupBy("node")
        .agg(F.max(F.struct("c", "first")).alias("m"), F.sum("c").alias("c"), F.max("q").alias("q"))
        .where("c >= q")
        .select("node", F.col("m.first").alias("anchor"))
    )
    parts = anchors.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("parts"))
    blocks = anchors.join(parts, "anchor").select("node", F.xxhash64("anchor", F.pmod("node", "parts")).alias("block"))
    return checkpointed(members.join(blocks, "node").select("key", "node", "need", "block"))


def sides_of_blocks(placed):
    """(x, y, block, node): for each two blocks x <= y, a block and itself included, the nodes of either that may have a partner in the other.

    A node needs as many keys in common with the other block as a partner has
    with it at least; pairs without such nodes on both sides go.
    """
    met = placed.groupBy("key", "block").agg(F.min("node").alias("low"), F.max("node").alias("high")).withColumnRenamed("block", "other")
    shared = checkpointed(
        placed.join(met, "key")
        .where("node <> low or node <> high")
        .groupBy("block", "other", "node")
        .agg(F.count("*").alias("c"), F.max("need").alias("q"))
        .where("c >= q")
        .select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node")
    )
    lively = shared.groupBy("x", "y").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("c"))
    return shared.join(lively.where("low = x and high = y and c > 1").select("x", "y"), ["x", "y"], "left_semi")


def ngram_links(docs, found, words=SHINGLE_WORDS, share=FREQUENT_SHARE):
    """Rows (node, other, n) of all pairs of blocks, as links_of_blocks gives them."""

    def links(key, rows):
        return links_of_blocks(key, rows, words)

    frequent = frequent_tokens(found, found.where("node is not null").count(), share)
    placed = placed_members(shared_members(docs, words, frequent))
    sets = sets_of_nodes(docs, found, placed.select("node").distinct(), words)
    compared = sides_of_blocks(placed).join(sets, "node").select("x", "y", "block", "node", "copies", "packed")
    return checkpointed(compared.groupBy("x", "y").applyInArrow(links, "node long, other long, n long"))


def ngram_jaccard_join(docs, words=SHINGLE_WORDS, share=FREQUENT_SHARE):
    """Sets, links and components of documents (doc_id, text) under n-gram Jaccard similarity.

    Returns (doc_id, n_shingles, n_links, component_id): the size of the
    document's set of distinct n-word shingles (blank-parted words, A-Z
    lower-cased), the number of other documents linked with it directly, by at
    least SIMILARITY hundredths, and the smallest doc_id reachable by links.

    A null or empty text and one of blanks only have no shingles and link with
    nothing; fewer than ``words`` words are one shingle.  Repeated rows give
    repeated rows and count as one document.  A null doc_id names no document:
    its row has its set size, its links and component are those of its equals,
    and it is nobody's link or representative.
    Other columns are ignored.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(sized_nodes(docs, words, share), "nodes")
    rows = found.where("token is null").select("doc_id", "n", "node")
    links = ngram_links(docs, found, words, share)
    labels = connected_components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.where("other is null").groupBy("node").agg(F.sum("n").alias("n_links"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("copies"))
    labelled = nodes.join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labelled.join(firsts, "label").select("node", "component_id", (F.col("copies") + F.coalesce("n_links", F.lit(0))).alias("linked"))
    itself = F.col("doc_id").isNotNull().cast("long")
    return rows.join(classes, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("linked") - itself, F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark, folder):
    return ngram_jaccard_join(table(spark, folder, "documents"))
