"""Conversation prefix trie: what conversations share, summed over subtrees band by band.

A node is a distinct sequence of first turns.  It is known by a hash of the
sequence, the exclusive or of its turns' hashes keyed by their depth, so the
hashes of all prefixes of a conversation are one running aggregate.

Subtree totals come from a depth-band rollup.  Depths are cut into bands of a
fixed height, and a node adds what it has to its ancestors within its own band
only, a handful of rows.  The first nodes of bands, each with its band's total,
form a trie themselves, of which one step is one band; it is summed in the same
way.  Then the completed total of each band's first node goes to its ancestors
in the band above.  So a node gives at most two bands' worth of rows on a
level, and the levels are as many as the logarithm of the depth to the base of
the height.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import ordered_sha256, partitions, stored
from inkveil.operators.skew import running_total, spread_lookup

HEIGHT = 32
BLOCK_BITS = 12
ID_BITS = 16
NODE = ["depth", "h1", "h2"]


def turn_hashes(role: Column, text: Column) -> dict[str, Column]:
    """Two independent 64-bit hashes of a turn and the code points in its text."""
    return {
        "t1": F.xxhash64(F.lit(1), role, text),
        "t2": F.xxhash64(F.lit(2), role, text),
        "chars": F.length(text).cast("bigint"),
    }


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Stored ``(conv_id, at, position, n, t1, t2, chars)``: each turn's number in its conversation, of ``n``.

    By turn, NULL first; ties by role, the first 64 code points of the text and
    its hash.  NULL roles and texts are empty; rows without an id belong to no
    conversation and are left out.  Texts are read, not shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keys = ["conv_id", "turn", "role", "head", "t1", "t2"]
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(role, 1, 64).alias("role"),
        F.substring(text, 1, 64).alias("head"),
        *[c.alias(name) for name, c in turn_hashes(role, text).items()],
    )
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    kept = placed.withColumn("at", F.monotonically_increasing_id()).select("conv_id", "at", "t1", "t2", "chars")
    return stored(running_total(stored(kept, "turns"), ["conv_id"], "at", into="position", total_into="n"), "turns")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """The turns of every conversation, rebuilt on the head of the one that begins its hundred.

    ``turns`` are numbered.  Conversation c takes the first h turns of c - c%100
    (all if there are fewer, none if it is absent) and then its own behind its
    first h, with h = crc32(decimal c) % 6 (c%100 is 0 to 99 for negative ids, too).  The result is ``(conv_id, depth,
    t1, t2, chars, last)`` with a row of depth 0 for every conversation;
    ``last`` marks where it ends.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).select(
        "conv_id", "n", head.alias("head"), (F.col("conv_id") - F.pmod("conv_id", F.lit(100))).alias("base")
    )
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("in_base"))
    convs = stored(
        convs.join(sizes, "base", "left")
        .withColumn("taken", F.least("head", F.coalesce("in_base", F.lit(0))))
        .select("conv_id", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("ends")),
        "turns",
    )
    roots = convs.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("t1", "t2", "chars")],
        (F.col("ends") == 0).alias("last"),
    )
    heads = turns.filter("position <= 5").select(F.col("conv_id").alias("base"), "position", "t1", "t2", "chars")
    first = convs.join(heads, "base").filter("position <= taken").select(
        "conv_id", F.col("position").alias("depth"), "t1", "t2", "chars", (F.col("position") == F.col("ends")).alias("last")
    )
    later = spread_lookup(
        turns.withColumn("head", head).filter("position > head"), convs.select("conv_id", "taken"), ["conv_id"], "at"
    )
    own = later.select(
        "conv_id", (F.col("taken") + F.col("position") - F.col("head")).alias("depth"), "t1", "t2", "chars",
        (F.col("position") == F.col("n")).alias("last"),
    )
    return roots.unionByName(first).unionByName(own)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Stored ``(conv_id, depth, h1, h2, up1, up2, chars, last)``: hashes of the prefix with and without each turn.

    The running aggregate is taken in blocks of depths, and over the blocks.
    """
    own = {
        f"x{i}": F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(
            F.xxhash64(F.lit(i), F.col("depth"), F.col("t1"), F.col("t2"))
        )
        for i in (1, 2)
    }
    block = F.shiftright("depth", BLOCK_BITS).alias("block")
    rows = stored(turns.withColumns(own).select("conv_id", block, "depth", "x1", "x2", "chars", "last"), "turns")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"before{i}") for i in (1, 2)]
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({f"run{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)})
    hashes = {f"h{i}": F.col(f"run{i}").bitwiseXOR(F.col(f"before{i}")) for i in (1, 2)}
    above = {f"up{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    joined = running.join(before, ["conv_id", "block"]).withColumns(hashes).withColumns(above)
    return stored(joined.select("conv_id", "depth", "h1", "h2", "up1", "up2", "chars", "last"), "prefixes")


def subtree_sums(members: DataFrame, nodes: DataFrame, values: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """``(depth, h1, h2)`` and the sums of ``values`` over each node's subtree, itself included.

    ``members`` are ``(conv_id, depth, h1, h2)``: the nodes that each
    conversation goes through, from depth 0 on without gaps.  ``nodes`` have
    the same key, the ``conv_id`` of one member, and the values.
    """
    band = F.floor(F.col("depth") / height).cast("bigint").alias("band")
    sums = [F.sum(v).alias(v) for v in values]
    placed = nodes.select("*", band)
    wanted = placed.select("conv_id", "band")
    if deepest >= height:  # the first node of a band also adds to the band above
        above = placed.filter(F.col("depth") % height == 0).select("conv_id", (F.col("band") - 1).alias("band"))
        wanted = wanted.unionByName(above)
    chain = members.select("conv_id", band, "depth", "h1", "h2").join(wanted.distinct(), ["conv_id", "band"], "left_semi")
    chains = stored(
        chain.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("chain")), "bands"
    )
    inside = placed.join(chains, ["conv_id", "band"]).select(
        F.explode(F.slice("chain", F.lit(1), (F.col("depth") - F.col("band") * height + 1).cast("int"))).alias("node"), *values
    )
    found = inside.groupBy(*[F.col(f"node.{c}").alias(c) for c in NODE]).agg(*sums)
    if deepest < height:
        return found
    found = stored(found, "bands")

    def lifted(df: DataFrame, *more: str) -> DataFrame:
        first = df.filter(F.col("depth") % height == 0)
        return first.select("conv_id", (F.col("depth") / height).cast("bigint").alias("depth"), "h1", "h2", *more)

    firsts = nodes.filter(F.col("depth") % height == 0).select("conv_id", *NODE).join(found, NODE)
    upper = stored(lifted(firsts, *values), "bands")
    whole = subtree_sums(stored(lifted(members), "bands"), upper, values, deepest // height, height)
    named = upper.select("conv_id", *NODE).join(whole, NODE).filter("depth > 0")
    carried = named.withColumn("band", F.col("depth") - 1).join(chains, ["conv_id", "band"]).select(F.explode("chain").alias("node"), *values)
    carried = carried.select(*[F.col(f"node.{c}").alias(c) for c in NODE], *values)
    return found.unionByName(carried).groupBy(*NODE).agg(*sums)


def prefix_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of ``turns (conv_id, depth, t1, t2, chars, last)``.

    Conversations are members of the nodes they begin with.  The columns:
    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (NULL at
    the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` and
    ``saved_tokens`` (over the subtree: childless nodes; members beyond the
    first times code points of the last text), ``ends_sha256`` (of the sorted,
    comma-joined ids of the members that end here).

    Depths run from a row of depth 0 for every conversation without gaps, as
    ``rebuilt_turns`` gives them; ids are not NULL.  Equal conversations meet in
    every node; a conversation without turns is a member of the root alone; an
    empty table has no nodes.  No group is collected but the ids of 2**16
    numbers and one band of one conversation.
    """
    members = _prefixes(turns)
    found = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("up1", "up2", "chars")]
    )
    found = stored(found, "nodes")
    deepest = found.agg(F.max("depth")).first()[0] or 0
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("h1"), F.col("up2").alias("h2"))
    nodes = stored(
        found.join(children.agg(F.count("*").alias("n_children")), NODE, "left").withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0)),
                "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("chars"),
            }
        ),
        "nodes",
    )
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(
        members.select("conv_id", *NODE), nodes.select("conv_id", *NODE, *values), values, deepest, height
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("h1").alias("up1"), F.col("h2").alias("up2"), F.col("conv_id").alias("parent_conv_id")
    )
    # Both sides of the join with parents are plain shuffles, so AQE can split a node with many children.
    joined = nodes.drop(*values).join(parents, ["depth", "up1", "up2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return joined.join(sums, NODE).join(_ends(members), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values,
        F.coalesce("sha256", F.lit(none)).alias("ends_sha256"),
    )


def _ends(members: DataFrame) -> DataFrame:
    """By node where conversations end: the hash of their ids, first joined in ranges of ids."""
    ended = members.filter("last").select(*NODE, "conv_id", F.shiftright("conv_id", ID_BITS).alias("range"))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    joined = ended.groupBy(*NODE, "range").agg(F.array_join(ids, ",").alias("ids"))
    return ordered_sha256(joined, NODE, ["range"], "ids", ",")


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The contract's columns are those of ``prefix_trie`` over the rebuilt conversations."""
    return prefix_trie(rebuilt_turns(numbered_turns(conversations)))
