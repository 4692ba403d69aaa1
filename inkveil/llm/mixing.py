"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source, document after document in a hashed order, are cut into
blocks.  Every output shard draws how many of its slots each source fills; the
slots of a source are numbered through all shards and mapped to its blocks by a
pseudorandom permutation of the block numbers, a new one each time the source
has been gone through; blocks are then found by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import WORD, small_batches, stored

_WORD = re.compile(WORD)


@dataclass(frozen=True)
class MixRules:
    """``weights`` go round the sources in code point order, NULL last.

    No source gives more than ``most`` times its words.  ``max_sources`` bounds
    what the driver holds (one line per source); more sources are an error.
    """

    weights: Sequence[float] = (1, 2, 3)
    most: int = 3
    block: int = 64
    slots_per_shard: int = 1 << 16
    min_shards: int = 4
    seed: int = 7
    max_sources: int = 100_000
    rows_per_bucket: int = 20_000


def target_words(sizes: Sequence[int], weights: Sequence[float], most: int) -> list[float]:
    """Shares of all words by weight, none above ``most`` times a source's size.

    What is above the bound is shared out among the others by weight, until
    none is above.
    """
    total, capped = float(sum(sizes)), [size == 0 for size in sizes]
    while True:
        fixed = sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        level = (total - fixed) / weight if weight else 0.0
        over = [not c and w * level > most * s for s, w, c in zip(sizes, weights, capped, strict=True)]
        if not any(over):
            return [float(most * s) if c else w * level for s, w, c in zip(sizes, weights, capped, strict=True)]
        capped = [c or o for c, o in zip(capped, over, strict=True)]


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: float  # expected


def plan_sources(sized: DataFrame, rules: MixRules) -> list[Source]:
    """The sources with their targets, from one sum per source."""
    found = sized.groupBy("__source").agg(F.sum("__size").alias("n")).limit(rules.max_sources + 1).collect()
    if len(found) > rules.max_sources:
        raise ValueError(f"More than {rules.max_sources} sources.")
    rows = sorted(((r["__source"], r["n"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    weights = [rules.weights[i % len(rules.weights)] for i in range(len(rows))]
    targets = target_words([n for _, n in rows], weights, rules.most)
    out = []
    for (name, n), target in zip(rows, targets, strict=True):
        blocks = -(-n // rules.block)
        out.append(Source(name, n, target, blocks, target * blocks / n if n else 0.0))
    return out


def draw_counts(expected: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Counts that sum to ``slots``: whole parts of the expectation, the rest drawn multinomially."""
    share = expected / expected.sum()
    whole = np.floor(share * slots).astype(np.int64)
    left = slots - int(whole.sum())
    if left > 0:
        rest = share * slots - whole
        rest = rest / rest.sum() if rest.sum() > 0 else share
        whole += rng.multinomial(left, rest)
    return whole


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROUNDS = np.arange(1, 5, dtype=np.uint64) * _M2


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, row by row.

    A four-round Feistel network over the least even number of bits that holds
    ``size``; results beyond it go through the network again.
    """
    size = size.astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2)).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << bits) - np.uint64(1), index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        b, m, k, x = bits[todo], mask[todo], key[todo].astype(np.uint64), out[todo]
        left, right = x >> b, x & m
        for tweak in _ROUNDS:
            mixed = _scramble(right + _scramble(k + tweak))
            left, right = right, left ^ (mixed & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def mix_slots(spark, sources: Sequence[Source], rules: MixRules) -> DataFrame:
    """``(shard, slot, src, block, pass)``: what fills each slot of each shard."""
    expected = np.array([s.slots for s in sources], dtype=float)
    total = round(float(expected.sum()))
    shards = max(rules.min_shards, -(-total // rules.slots_per_shard))
    schema = "shard bigint, src int, n bigint"
    if total == 0:
        empty = spark.createDataFrame([], schema)
        return empty.select("shard", F.col("n").alias("slot"), "src", F.col("n").alias("block"), F.col("n").alias("pass"))

    out = pa.schema([("shard", pa.int64()), ("src", pa.int32()), ("n", pa.int64())])

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard in part.column("id").to_pylist():
                slots = total * (shard + 1) // shards - total * shard // shards
                rng = np.random.Generator(np.random.Philox(key=[rules.seed, shard]))
                counts = draw_counts(expected, int(slots), rng)
                src = np.flatnonzero(counts)
                columns = [np.full(len(src), shard), src.astype(np.int32), counts[src]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    drawn = spark.range(shards).mapInArrow(draw, schema)
    blocks = F.get(F.array(*[F.lit(int(s.blocks)) for s in sources]), F.col("src")).cast("bigint")
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        stored(drawn, "draws")
        .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .withColumn("blocks", blocks)
        # What a draw adds beyond the bound of its source is left out.
        .withColumn("n", F.least("n", F.col("blocks") * rules.most - F.col("first")))
        .filter("n > 0")
        .repartition("shard", "src")
    )
    numbered = placed.select(
        "shard", "src", "blocks", "at", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j")
    ).select(
        "shard", (F.col("at") + F.col("j")).alias("slot"), "src", "blocks", (F.col("first") + F.col("j")).alias("k")
    )
    seed = rules.seed

    def mapped(k: pa.Array, size: pa.Array, src: pa.Array) -> pa.Array:
        k, size, src = k.to_numpy(), size.to_numpy(), src.to_numpy().astype(np.uint64)
        key = (src << np.uint64(32)) + (k // size).astype(np.uint64) + (np.uint64(seed) << np.uint64(56))
        return pa.array(permute(k % size, size, key))

    block = F.arrow_udf(mapped, "bigint")(F.col("k"), F.col("blocks"), F.col("src"))
    return numbered.select(
        "shard", "slot", "src", block.alias("block"), F.floor(F.col("k") / F.col("blocks")).alias("pass")
    )


def _sized(docs: DataFrame, source: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("__doc"),
        F.col(source).cast("string").alias("__source"),
        F.xxhash64(text).alias("__h"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("__size"),
    )


def _source_table(spark, sources: Sequence[Source]) -> DataFrame:
    lines = [(s.name, i, s.size, s.target) for i, s in enumerate(sources)]
    return F.broadcast(
        spark.createDataFrame(lines, "__source string, src int, __source_size bigint, __target double")
    )


def placed_documents(docs: DataFrame, source: str, rules: MixRules) -> tuple[DataFrame, list[Source]]:
    """Documents with their number of words and their place in the source's stream.

    Sums run over buckets of a source and then over the rows of a bucket, so
    that no window holds a source as a whole.
    """
    spark = docs.sparkSession
    sized = stored(_sized(docs, source), "sizes")
    sources = plan_sources(sized, rules)
    buckets = max(64, -(-sized.count() // rules.rows_per_bucket))
    table = _source_table(spark, sources)
    rows = (
        sized.withColumnRenamed("__source", "__name")
        .join(table, F.col("__name").eqNullSafe(F.col("__source")))
        .drop("__name")
        .withColumn("__bucket", F.pmod(F.xxhash64("__doc", "__h"), F.lit(buckets)).cast("int"))
    )
    sums = rows.groupBy("src", "__bucket").agg(F.sum("__size").alias("n"))
    ahead = Window.partitionBy("src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "__bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__ahead"))
    own = Window.partitionBy("src", "__bucket").orderBy("__doc", "__h").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("__own", F.coalesce(F.sum("__size").over(own), F.lit(0)))
        .join(starts, ["src", "__bucket"])
        .withColumn("__start", F.col("__ahead") + F.col("__own"))
        .select("__doc", "__h", "__source", "src", "__size", "__source_size", "__target", "__start")
    )
    return stored(placed, "placed"), sources


def mixed_pieces(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """The parts of each document in its blocks, with ``uses``, the number of slots a block fills."""
    last = F.floor((F.col("__start") + F.col("__size") - 1) / block)
    pieces = placed.filter("__size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("__start") / block), last))
    )
    begin = F.greatest(F.col("__start"), F.col("block") * block)
    end = F.least(F.col("__start") + F.col("__size"), (F.col("block") + 1) * block)
    uses = slots.groupBy("src", "block").agg(F.count("*").alias("uses"))
    return pieces.join(uses, ["src", "block"], "left").select(
        *placed.columns,
        "block",
        (begin - F.col("__start")).alias("begin"),
        (end - begin).alias("words"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
    )


def mix(docs: DataFrame, source: str = "source", rules: MixRules = MixRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of documents, of their pieces with uses, and of the mix's slots.

    A mix is ``slots`` in the order of (shard, slot), each a block of a source;
    a block is its documents' ``pieces``.  NULL and empty texts have no words
    and no pieces; NULL sources are a source; rows repeated are documents of
    their own; an empty table gives empty tables.
    """
    placed, sources = placed_documents(docs, source, rules)
    slots = stored(mix_slots(docs.sparkSession, sources, rules), "slots")
    return placed, mixed_pieces(placed, slots, rules.block), slots


def op2_mixing(docs: DataFrame) -> DataFrame:
    """Per document the words that the mix takes, repeats counted."""
    placed, pieces, _ = mix(docs)
    taken = pieces.groupBy(*placed.columns).agg(F.sum(F.col("uses") * F.col("words")).alias("taken"))
    none = placed.filter("__size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return taken.unionByName(none).select(
        F.col("__doc").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("taken").cast("bigint"),
    )


def passages(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """One text per pass: the words of the pieces with more uses than passes before.

    ``pieces`` are (first word, words, uses).  A pass that takes all is the text.
    """
    pieces = sorted(pieces)
    top = max(uses for _, _, uses in pieces)
    words = None
    out = []
    for done in range(top):
        if all(uses > done for _, _, uses in pieces):
            out.append(text)
            continue
        if words is None:
            words = [m.span() for m in _WORD.finditer(text)]
        runs: list[list[int]] = []
        for begin, n, uses in pieces:
            if uses > done:
                if runs and runs[-1][1] == begin:
                    runs[-1][1] = begin + n
                else:
                    runs.append([begin, begin + n])
        out.append("\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
    return out


def mix_documents(docs: DataFrame, source: str = "source", rules: MixRules = MixRules()) -> DataFrame:
    """The mix as documents: a row per pass through a document, with the words taken in it.

    Documents of which nothing is taken are left out, those taken whole come as
    they are, and a document taken repeatedly comes repeatedly.  ``n_chars``
    follows the text.  Texts are shuffled once, by a hash of the row.
    """
    small_batches(docs.sparkSession)
    placed, pieces, _ = mix(docs, source, rules)
    key = F.struct("__doc", "__h", "__source")  # never NULL
    each = F.struct(F.col("begin").cast("int"), F.col("words").cast("int"), F.col("uses").cast("int"))
    used = (
        pieces.groupBy(key.alias("__key"), "__start")
        .agg(F.collect_list(each).alias("__pieces"), F.max("uses").alias("__top"))
        .filter("__top > 0")
        # Rows alike in all of the key are told apart by number; which is which shows in no result.
        .withColumn("__number", F.row_number().over(Window.partitionBy("__key").orderBy("__start")))
        .select("__key", "__number", "__pieces")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    # Other columns travel as one value, so none of their names matters.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(
            F.col("doc_id").cast("bigint").alias("__doc"),
            F.xxhash64(text).alias("__h"),
            F.col(source).cast("string").alias("__source"),
        ).alias("__key"),
    ).withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0))))

    def taken(texts: pa.Array, parts: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), parts.to_pylist(), strict=True)
        found = [passages(t, [tuple(p.values()) for p in ps]) for t, ps in pairs]
        return pa.array(found, type=pa.list_(pa.string()))

    cut = F.arrow_udf(taken, "array<string>")(F.coalesce("row.text", F.lit("")), F.col("__pieces"))
    # The number is compared as a difference, so that the join is on the key alone
    # and texts stay where the window has them.
    same = (rows["__key"] == used["__key"]) & (F.col("__copy") - F.col("__number") == 0)
    done = rows.join(used, same).withColumn("__taken", F.explode(cut))
    columns = {"text": F.col("__taken"), "n_chars": F.length("__taken").cast("bigint")}
    return done.select(*[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
