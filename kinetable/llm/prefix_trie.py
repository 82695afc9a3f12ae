"""The trie of conversation prefixes, with subtree totals by time-forward processing.

Every conversation is first rebuilt: the first turns of the first one of its
block of five, then its own.  A node is a distinct sequence of first turns;
its name is (smallest member, depth).  Positions and the digests of prefixes
are running sums in slices, so one long conversation is many tasks.

Subtree totals pass from the nodes to their parents in reverse level order:
the nodes of a shard are sorted by falling depth, and a priority queue that
spills to disk holds each node's totals until its parent comes by.  Shards
are whole subtrees: nodes with more than 1/4096 of all path rows as members
(at most 4096 nodes, with all their ancestors) form the top of the trie, and
the subtrees that hang on it are dealt to the shards by their root.  The
roots' totals, summed by parent, then pass through the top in the same way.
Nodes of one member need no messages: nothing branches below them.

Answers to odd rows: a null role or text is empty; a null turn comes first;
turns of one number go by a digest of role and text; repeated rows are turns
of their own; rows with a null conv_id belong to no conversation and make no
node; an empty table has no nodes; other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window, functions as F

from kinetable.llm.base import query, table, written
from kinetable.llm.spill_queue import KEPT_MESSAGES, SpillingQueue
from kinetable.operators.ordering import with_position

#: Fixed values of the contract: size of a block, modulus of the number of shared turns.
BLOCK = 5
HEADS = 9
#: A node of the top has more than 1/TOP_SHARE of all path rows as members.
TOP_SHARE = 4096
#: Turns of a slice of a conversation.
SLICE = 4096
#: Digests of prefixes: this many sums of values of 36 bits each.
LANES = 4
#: Bytes of the joined ids that are handed on as one row.
CHUNK = 1 << 16
NO_TURN = -(1 << 63)


def shared_turns(conv):
    """How many first turns a conversation takes from the first one of its block."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("long")


def turn_rows(conversations):
    """(conv, pos, d1, d2, size): a digest and the bytes of every turn, numbered from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit("second"), role, text).alias("d2"),
        F.octet_length(text).cast("long").alias("size"),
    ).where("conv is not null")
    return with_position(turns, ["conv"], ["turn", "d1", "d2"]).drop("turn")


def rebuilt(turns):
    """((conv, depth, d1, d2, size), (conv)): the rebuilt turns from depth 1, and all conversations."""
    first = F.col("conv") - F.col("conv") % BLOCK
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    convs = sizes.select("conv", first.alias("first"), shared_turns(F.col("conv")).alias("shared"))
    firsts = sizes.select(F.col("conv").alias("first"), F.col("turns").alias("there"))
    convs = convs.join(firsts, "first", "left").withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0))))
    heads = turns.where((F.col("conv") == first) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv", "first")
    taken = heads.join(convs, "first").where(F.col("pos") < F.col("shared"))
    taken = taken.select("conv", (F.col("pos") + 1).alias("depth"), "d1", "d2", "size")
    moved = convs.where("taken < shared").select("conv", (F.col("shared") - F.col("taken")).alias("less"))
    own = turns.where(F.col("pos") >= shared_turns(F.col("conv"))).join(moved, "conv", "left")
    own = own.select("conv", (F.col("pos") + 1 - F.coalesce("less", F.lit(0))).alias("depth"), "d1", "d2", "size")
    return taken.unionByName(own), convs.select("conv")


def path_rows(turns):
    """(conv, depth, a, b, pa, pb, size, ends): the node of every turn, its parent, and whether the conversation ends there.

    A prefix is known by four running sums of digests of (turn, depth), each
    below 2**63 for conversations of up to 2**27 turns, and these by two
    64-bit digests.  Sums run inside slices of a conversation; only slices
    after the first need the totals of those before them.
    """
    lanes = [f"k{i}" for i in range(LANES)]
    valued = turns.select(
        "conv", "depth", "size", F.floor((F.col("depth") - 1) / SLICE).alias("slice"),
        *[F.shiftrightunsigned(F.xxhash64(F.lit(i), "d1", "d2", "depth"), 28).alias(k) for i, k in enumerate(lanes)],
    )
    along = Window.partitionBy("conv").orderBy("slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = valued.groupBy("conv", "slice").agg(*[F.sum(k).alias(k) for k in lanes], F.max("depth").alias("length"))
    totals = totals.select(
        F.col("conv").alias("_c"), F.col("slice").alias("_s"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in lanes],
        F.max("length").over(Window.partitionBy("conv")).alias("length"),
    )
    inside = Window.partitionBy("conv", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.select("*", *[F.sum(k).over(inside).alias(f"s{k}") for k in lanes])
    joined = summed.join(totals, (F.col("conv") == F.col("_c")) & (F.col("slice") == F.col("_s")))
    here = [F.col(f"s{k}") + F.col(f"_{k}") for k in lanes]
    above = [s - F.col(k) for s, k in zip(here, lanes)]
    up = F.col("depth") - 1

    def name(depth, sums, salt):
        return F.when(depth == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(salt), depth, *sums))

    return joined.select(
        "conv", "depth",
        *[name(F.col("depth"), here, s).alias(n) for s, n in ((1, "a"), (2, "b"))],
        *[name(up, above, s).alias(n) for s, n in ((1, "pa"), (2, "pb"))],
        "size", (F.col("depth") == F.col("length")).alias("ends"),
    )


def node_rows(paths):
    """(a, b, conv, depth, pa, pb, n_convs, n_ends, own): one row a node below the root, with what it saves itself."""
    rows = paths.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), *[F.min(c).alias(c) for c in ("depth", "pa", "pb", "size")],
        F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"),
    )
    return rows.withColumn("own", (F.col("n_convs") - 1) * F.col("size")).drop("size")


def with_parents(nodes, top, root):
    """Nodes with their parent's name and number of members.

    Children of the top's nodes (at most TOP_SHARE) meet them by broadcast, so
    no task gets the children of a hot parent; any other parent has few.
    """
    below = nodes.where("depth > 1")
    facts = [F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv"), F.col("n_convs").alias("parent_n")]
    hot = F.broadcast(top.select(*facts))
    light = nodes.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_anti").select(*facts)
    first = nodes.where("depth = 1").withColumns({"parent_conv": F.lit(root["conv"]).cast("long"), "parent_n": F.lit(root["n"]).cast("long")})
    second = below.join(hot, ["pa", "pb"])
    third = below.join(hot.select("pa", "pb"), ["pa", "pb"], "left_anti").join(light, ["pa", "pb"])
    return first.unionByName(second).unionByName(third)


def subtree_roots(paths, top):
    """(conv, ra, rb): the node at which each conversation leaves the top, where it does."""
    inside = paths.join(F.broadcast(top.select("a", "b")), ["a", "b"]).groupBy("conv").agg(F.count(F.lit(1)).alias("top_turns"))
    placed = paths.join(F.broadcast(top.select("a", "b")), ["a", "b"], "left_anti").select("conv", "depth", "a", "b").join(inside, "conv", "left")
    at = F.col("depth") == F.coalesce("top_turns", F.lit(0)) + 1
    return placed.where(at).select("conv", F.col("a").alias("ra"), F.col("b").alias("rb"))


FIELDS = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "a", "b")
TOTALS = ", ".join(f"{c} long" for c in FIELDS) + ", up boolean"


def time_forward(rows, kept=KEPT_MESSAGES):
    """Totals of the nodes of each partition, which comes by falling depth, then conv.

    ``rows`` has (conv, depth, parent_conv, n_convs, own, a, b, kind, n_children,
    n_leaves, saved).  Kinds: 0 a message for the node of that name with totals
    from another shard, 1 a node, 2 a node of one member, whose totals are in
    the row, +4 for a node whose parent is not in the shard.  Returns
    the nodes with their totals, and with ``up`` the messages of the shard's
    roots, addressed to the parent.
    """

    def run(batches):
        queue = SpillingQueue(3, kept)
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "depth", "parent_conv", "n_convs", "own", "a", "b", "kind", "n_children", "n_leaves", "saved")]
            for conv, depth, parent, n_convs, own, a, b, kind, children, leaves, saved in zip(*columns):
                if kind == 0:
                    queue.push((-depth, conv), (children, leaves, saved))
                    continue
                if kind & 3 == 1:
                    children, leaves, saved = queue.pop((-depth, conv)) or (0, 1, 0)
                    saved += own
                else:
                    queue.pop((-depth, conv))
                out.append((conv, depth, parent, n_convs, children, leaves, saved, a, b, False))
                if kind & 4:
                    out.append((parent, depth - 1, None, 0, 1, leaves, saved, 0, 0, True))
                elif depth:
                    queue.push((1 - depth, parent), (1, leaves, saved))
            kinds = [pa.int64()] * len(FIELDS) + [pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=[*FIELDS, "up"])

    return rows.mapInArrow(run, TOTALS)


def by_level(rows):
    """The order of time-forward processing: deepest first, a node's messages before it."""
    return rows.sortWithinPartitions(F.desc("depth"), "conv", "kind")


def digests_of_ends(ends):
    """(a, b, ends_sha256): the digest of the joined ids of each node's conversations, in order of the ids.

    Ids are joined in ranges of (node, id) first, so the members of a hot node
    are formatted in many tasks; a node's digest then only reads its chunks,
    one after the other.
    """

    def chunks(batches):
        name, first, parts, size = None, None, [], 0
        for batch in batches:
            out = []
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv"))):
                if (a, b) != name or size > CHUNK:
                    if parts:
                        out.append((*name, first, ",".join(parts)))
                    name, first, parts, size = (a, b), conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            yield chunk_batch(out)
        if parts:
            yield chunk_batch([(*name, first, ",".join(parts))])

    def digests(batches):
        name, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != name:
                    if name:
                        out.append((*name, digest.hexdigest()))
                    name, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield digest_batch(out)
        if name:
            yield digest_batch([(*name, digest.hexdigest())])

    spread = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    joined = spread.mapInArrow(chunks, "a long, b long, first long, ids string")
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digests, "a long, b long, ends_sha256 string")


def chunk_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["a", "b", "first", "ids"])


def digest_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds)], names=["a", "b", "ends_sha256"])


def prefix_trie(conversations, top_share=TOP_SHARE, kept=KEPT_MESSAGES):
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(turn_rows(conversations), "turns")
    taken, convs = rebuilt(turns)
    paths = written(path_rows(taken), "paths")
    convs = written(convs, "convs")
    nodes = written(node_rows(paths), "nodes")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    path_count = paths.count()
    top = nodes.where(F.col("n_convs") * top_share > path_count)
    known = with_parents(nodes, top, root)
    marked = known.join(F.broadcast(top.select("a", "b", F.lit(True).alias("in_top"))), ["a", "b"], "left")
    marked = written(marked.withColumn("in_top", F.coalesce("in_top", F.lit(False))), "marked")

    none = F.lit(0).cast("long")
    names = ["conv", "depth", "parent_conv", "n_convs"]
    single = F.col("n_convs") == 1
    alone = marked.where(single & ~F.col("in_top") & (F.col("parent_n") == 1)).select(
        *names, (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), none.alias("saved"), "a", "b"
    )
    shard = marked.where(~F.col("in_top") & (F.col("parent_n") > 1)).join(subtree_roots(paths, top), "conv")
    at_root = (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))
    kind = F.when(single, 2).otherwise(1) + F.when(at_root, 4).otherwise(0)
    shard = shard.repartition("ra", "rb").select(
        *names, "own", "a", "b", kind.alias("kind"),
        (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), none.alias("saved"),
    )
    below = written(time_forward(by_level(shard), kept), "below")

    messages = below.where("up").groupBy("conv", "depth").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
    messages = messages.select(
        "conv", "depth", F.lit(None).cast("long").alias("parent_conv"), none.alias("n_convs"), none.alias("own"), none.alias("a"), none.alias("b"),
        F.lit(0).alias("kind"), "n_children", "n_leaves", "saved",
    )
    upper = marked.where("in_top").select(
        *names, "own", "a", "b", F.when(single, 2).otherwise(1).alias("kind"), (1 - F.col("n_ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), none.alias("saved"),
    )
    start = convs.groupBy().agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv", none.alias("depth"), F.lit(None).cast("long").alias("parent_conv"), "n_convs", none.alias("own"), none.alias("a"), none.alias("b"),
        F.lit(1).alias("kind"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved"),
    )
    # At most TOP_SHARE nodes, the root and as many messages, whatever the size of the input.
    whole_top = time_forward(by_level(upper.unionByName(start).unionByName(messages).repartition(1)), kept)

    totals = alone.unionByName(below.where("not up").drop("up")).unionByName(whole_top.drop("up"))
    turnless = convs.join(paths.where("depth = 1").select("conv"), "conv", "left_anti").select(none.alias("a"), none.alias("b"), "conv")
    ends = paths.where("ends").select("a", "b", "conv").unionByName(turnless)
    digest = digests_of_ends(ends)
    empty = hashlib.sha256(b"").hexdigest()
    return totals.join(digest, ["a", "b"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"""


@query(
    "op12_prefix_trie",
    f"""with turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
      coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    convs as (select c, c - c % {BLOCK} as p, {CRC} % {HEADS} as h from (select distinct c from turns)),
    taken as (select convs.c, h, count(pos) as m from convs left join turns on turns.c = p and pos < h group by all),
    built as (select convs.c, pos + 1 as d, role, text from convs join turns on turns.c = p and pos < h
      union all select turns.c, pos + 1 - h + m, role, text from turns join taken using (c) where pos >= h),
    paths as (select c, d, strlen(text) as size, max(d) over (partition by c) as last,
      string_agg(md5(length(role) || ':' || role || text), '') over (partition by c order by d) as k from built),
    members as (select c, d, size, k, d = last as ends from paths
      union all select c, 0, 0, '', not exists (select 1 from built b where b.c = convs.c) from convs),
    nodes as (select k, min(c) as conv, any_value(d) as d, count(*) as n, (count(*) - 1) * any_value(size) as own,
      sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256,
      left(k, greatest(length(k) - 32, 0)) as up from members group by k),
    graded as (select nodes.*, coalesce(kids, 0) as kids from nodes
      left join (select up as k, count(*) as kids from nodes where d > 0 group by up) using (k)),
    totals as (select m.k, sum(own) as saved, count(*) filter (kids = 0) as leaves
      from graded g join members m on m.c = g.conv and m.d <= g.d group by m.k)
    select g.conv as conv_id, g.d::bigint as depth, case when g.d > 0 then u.conv end as parent_conv_id, g.n::bigint as n_convs,
      g.kids::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, g.ends_sha256
    from graded g join totals using (k) left join nodes u on u.k = g.up""",
)
def op12_prefix_trie(spark, folder):
    return prefix_trie(table(spark, folder, "conversations"))
