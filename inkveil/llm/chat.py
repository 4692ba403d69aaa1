"""Chat formatting: reply trees to conversations, one per chosen root-to-leaf path.

Paths are enumerated by self-joins that double their reach: round k knows every
message's ancestor 2**k steps up and the score on the way, so the number of
joins is the logarithm of the depth.  Branches are ranked by the mean score of
their messages, and each chosen path becomes one text with marked turns, in
which control strings that a message brings along are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import stored

# The marks, and what may not appear unescaped inside a message.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# "<|...", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"
_CONTROL = r"([<\[])(?=\||/?s>|</?SYS>>|/?INST\])"
_ESCAPED = r"\\(?:(\\)|:)"


def escape(text: Column) -> Column:
    """Double every backslash, then put ``\\:`` behind the first character of control strings."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\:")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given (a NULL as an empty one)."""
    return F.regexp_replace(text, _ESCAPED, "$1")


def _doubled(nodes: DataFrame) -> list[DataFrame]:
    """By round k: ``(__tree, __node, __up)``, each message's ancestor 2**k up, where it has one.

    Rounds get smaller as paths end, and the last one is empty but for messages
    on a cycle or below one: these always have an ancestor, so the rounds also
    end when 2**k exceeds the number of messages.
    """
    known = nodes.select("__tree", F.col("__node").alias("__up"))
    first = nodes.select("__tree", "__node", F.col("__parent").alias("__up")).filter("__up IS NOT NULL")
    rounds, most = [stored(first.join(known, ["__tree", "__up"], "left_semi"), "paths")], nodes.count()
    while (1 << (len(rounds) - 1)) <= most and rounds[-1].limit(1).count():
        at = rounds[-1]
        above = at.select("__tree", F.col("__node").alias("__up"), F.col("__up").alias("__next"))
        step = at.join(above, ["__tree", "__up"]).select("__tree", "__node", F.col("__next").alias("__up"))
        rounds.append(stored(step, "paths"))
    return rounds


def format_trees(
    messages: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int | None = None,
    learn: str = "assistant",
) -> DataFrame:
    """``(tree, leaf, rank, score, n_turns, formatted, spans)``, one row per chosen path.

    ``spans`` are ``(start, length)`` in code points of the ``learn`` role's
    texts in ``formatted``, the loss mask.  ``branches`` keeps that many leaves
    of a tree, by mean score downwards, then by leaf; by default all are kept.

    ``node`` is a BIGINT, unique in its tree.  A message whose parent is NULL
    or missing is a root; messages on a cycle or below one have no root and are
    left out.  NULL trees form one tree; NULL roles, texts and scores count as
    empty and 0; an empty table gives no rows; other columns are not read.
    """
    rows = messages.select(
        F.struct(F.col(tree).alias("tree")).alias("__tree"),
        F.col(node).cast("bigint").alias("__node"),
        F.col(parent).cast("bigint").alias("__parent"),
        (F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("__score"),
        escape(F.col(role)).alias("__role"),
        escape(F.col(text)).alias("__text"),
        (F.coalesce(F.col(role), F.lit("")) == learn).alias("__learn"),
    )
    nodes = stored(rows.select("__tree", "__node", "__parent", "__score"), "nodes")
    paths = _paths(nodes, _doubled(nodes))
    ranked = _ranked(paths, nodes if score is not None else None, branches)
    return _formatted(paths.join(ranked, ["__tree", "__leaf"]), rows)


def _paths(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``(__tree, __leaf, __node, __far)``: every message between a leaf and its root.

    In round k those known so far, up to 2**k steps from their leaf, give those
    as far beyond.
    """
    parents = rounds[0].select("__tree", F.col("__up").alias("__node"))
    endless = rounds[-1].select("__tree", "__node")
    leaves = nodes.select("__tree", "__node").join(parents.unionByName(endless), ["__tree", "__node"], "left_anti")
    found = leaves.select("__tree", F.col("__node").alias("__leaf"), "__node", F.lit(0).cast("bigint").alias("__far"))
    for k, jump in enumerate(rounds[:-1]):  # no leaf has an ancestor in the last
        higher = found.join(jump, ["__tree", "__node"]).select(
            "__tree", "__leaf", F.col("__up").alias("__node"), (F.col("__far") + (1 << k)).alias("__far")
        )
        found = stored(found.unionByName(higher), "paths")
    return found


def _ranked(paths: DataFrame, nodes: DataFrame | None, branches: int | None) -> DataFrame:
    """``(__tree, __leaf, __mean, __place)`` of the branches that are chosen."""
    if nodes is None:
        means = paths.filter("__far = 0").select("__tree", "__leaf", F.lit(0.0).alias("__mean"))
    else:
        scored = paths.join(nodes.select("__tree", "__node", "__score"), ["__tree", "__node"])
        means = scored.groupBy("__tree", "__leaf").agg(F.avg("__score").alias("__mean"))
    order = Window.partitionBy("__tree").orderBy(F.desc("__mean"), "__leaf")
    ranked = means.withColumn("__place", F.row_number().over(order))
    return ranked if branches is None else ranked.filter(F.col("__place") <= branches)


def _formatted(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Each path's turns as one text, with the spans of the loss mask."""
    path = Window.partitionBy("__tree", "__leaf").orderBy(F.desc("__far"))
    head = F.concat(F.lit(TURN), F.col("__role"), F.lit(TEXT))
    turns = (
        paths.join(rows.drop("__parent", "__score"), ["__tree", "__node"])
        .withColumn("__piece", F.concat(head, F.col("__text"), F.lit(END)))
        .withColumn("__begin", F.sum(F.length("__piece")).over(path) - F.length("__text") - len(END))
    )
    each = F.struct(
        (-F.col("__far")).alias("at"),
        F.col("__piece").alias("piece"),
        F.col("__learn").alias("learn"),
        F.col("__begin").cast("bigint").alias("start"),
        F.length("__text").cast("bigint").alias("length"),
    )
    whole = turns.groupBy("__tree", "__leaf", "__place", "__mean").agg(
        F.sort_array(F.collect_list(each)).alias("__turns")
    )
    learned = F.filter("__turns", lambda t: t["learn"])
    return whole.select(
        F.col("__tree.tree").alias("tree"),
        F.col("__leaf").alias("leaf"),
        F.col("__place").alias("rank"),
        F.col("__mean").alias("score"),
        F.size("__turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("__turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(learned, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation."""
    parts = F.split(formatted, r"<\|end\|>", -1)

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(TURN) + 1, 2**31 - 1), TEXT, 1)
        text = F.substring(part, F.length(role) + len(TURN) + len(TEXT) + 1, F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn answers the one before it.

    Repeated turns stand in the order of (turn, role, text).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("bigint").alias("node"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text")


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op8_chat(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text and its loss mask."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_CASE).alias("text"),
    )
    done = format_trees(linear_trees(rows.unionByName(extra)))
    lines = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return (
        done.withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss", F.array_join(masked, ""))
        .select(
            F.col("tree").alias("conv_id"),
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )
