"""MinHash near-dedup with b-bit signatures.

A document's set are its distinct word shingles.  Documents with equal sets are
one node from the start.  Of every node 5 * bands minima of hash permutations
are taken; five make a band's key, and of each only the lowest b bits are kept,
packed into two bit planes.  Nodes that share a key are candidates; their
similarity is estimated from the number of equal b-bit codes, corrected for the
codes that are equal by chance, and links are confirmed on the full sets.

A bucket (the nodes of one key) is never expanded into pairs.  First every
member is compared with the bucket's most central node, the one with the most
company in all its buckets; that joins nearly all groups.  Only buckets whose
members then still lie in several components are looked into again, in chunks
of bounded size against chunks, where only links that join components are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import batches, small_batches, stored, words_of
from inkveil.llm.components import components

ROWS = 5  # minima in a band's key
BITS = 2  # kept of each minimum
CHANCE = 1 / (1 << BITS)


@dataclass(frozen=True)
class NearRules:
    """Documents with ``100 * intersection >= percent * union`` are linked.

    ``missed`` bounds the probability that a link at the threshold shares no
    band; it sets the number of bands.  ``chunk`` bounds the members of a
    bucket that one task compares with as many others, ``chunk_shingles`` the
    shingles of their sets; ``broadcast_rows`` bounds the ids sent to
    all executors to find candidates' texts, beyond it a shuffle join does.
    """

    shingle: int = 5
    percent: int = 80
    missed: float = 1e-7
    chunk: int = 1024
    chunk_shingles: int = 1 << 20
    broadcast_rows: int = 1_000_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.missed) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def least_estimate(self) -> float:
        """Five standard deviations of the estimate below the threshold."""
        j = self.percent / 100
        equal = CHANCE + (1 - CHANCE) * j
        return j - 5 * math.sqrt(equal * (1 - equal) / (ROWS * self.bands)) / (1 - CHANCE)

    @property
    def most_unequal(self) -> int:
        """The most unequal codes at which a pair is a candidate."""
        equal = CHANCE + (1 - CHANCE) * self.least_estimate
        return math.floor(ROWS * self.bands * (1 - equal))

    @property
    def words(self) -> int:
        """Longs in a bit plane."""
        return -(-ROWS * self.bands // 64)


_RNG = np.random.Generator(np.random.Philox(key=[5, 8]))
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = (_RNG.integers(0, 1 << 31, 4096, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, 4096, dtype=np.uint32)
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.cumprod(np.full(1 << 16, _PRIME, dtype=np.uint64))]


def _powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        last = _POWERS[0]
        _POWERS[0] = np.concatenate([last, last * last[-1]])
    return _POWERS[0][:n]


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words where they are fewer.

    Running sums of byte values times powers of an odd number give the hash of
    any stretch of the text as a difference, made independent of its place by
    the power of the stretch's end, so all shingles are hashed at once.
    """
    if not words:
        return np.zeros(0, dtype=np.uint64)
    text = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    powers = _powers(len(text) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_TABLE[text] * powers[: len(text)])])
    # Every stretch times the power missing to the text's end, then less that of the text.
    value = (sums[ends] - sums[starts]) * powers[len(text) - starts] * _inverse(len(text))
    value = (value ^ (value >> np.uint64(32))) * _MIX
    value = (value ^ (value >> np.uint64(29))) * _MIX
    return np.unique(value ^ (value >> np.uint64(32)))


def _inverse(n: int) -> np.ndarray:
    """The power that undoes the n-th one, modulo 2**64."""
    return np.array([pow(int(_PRIME), -n, 1 << 64)], dtype=np.uint64)


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` permutations of 32 bits over a set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    factors, shifts = _FACTORS[:count, None], _SHIFTS[:count, None]
    for i in range(0, len(low), 512):
        part = low[None, i : i + 512] * factors
        part += shifts
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signature(hashes: np.ndarray, rules: NearRules) -> tuple[list[int], list[int]]:
    """Band keys, and the two bit planes of the minima's lowest bits, as longs."""
    least = minima(hashes, ROWS * rules.bands)
    keys = np.arange(1, rules.bands + 1, dtype=np.uint64) * _PRIME
    for column in least.reshape(rules.bands, ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(31)
    planes = []
    for bit in range(BITS):
        bits = np.zeros(rules.words * 64, dtype=np.uint8)
        bits[: len(least)] = least >> np.uint32(bit) & np.uint32(1)
        planes += np.packbits(bits).view(np.int64).tolist()
    return keys.view(np.int64).tolist(), planes


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]
    + [("bands", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))]
)


def signatures(docs: DataFrame, rules: NearRules) -> DataFrame:
    """``(doc_id, n, digest, bands, planes)``: a set's size and hash, its keys and planes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for doc, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                    hashes = shingle_set(words_of(text), rules.shingle)
                    if len(hashes):
                        digest = xxhash.xxh3_128_digest(hashes.tobytes())
                        yield doc, len(hashes), digest, *signature(hashes, rules)
                    else:
                        yield doc, 0, None, None, None

        yield from batches(rows(), _SIGNED, 2000)

    ddl = "doc_id bigint, n bigint, digest binary, bands array<bigint>, planes array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def full_sets(docs: DataFrame, rules: NearRules) -> DataFrame:
    """``(node, members array<bigint>)`` of the texts' full sets."""
    out = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for doc, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                    yield doc, shingle_set(words_of(text), rules.shingle).view(np.int64)

        yield from batches(rows(), out, 500)

    return docs.select("doc_id", "text").mapInArrow(run, "node bigint, members array<bigint>")


def _unequal(one: str, other: str, rules: NearRules) -> Column:
    """Number of unequal codes of two plane columns: those that differ in either plane."""
    total = F.lit(0)
    for i in range(rules.words):
        apart = F.lit(0).cast("bigint")
        for plane in range(BITS):
            at = plane * rules.words + i
            apart = apart.bitwiseOR(F.get(F.col(one), F.lit(at)).bitwiseXOR(F.get(F.col(other), F.lit(at))))
        total = total + F.bit_count(apart)
    return total


def estimate(unequal: Column, rules: NearRules) -> Column:
    """Similarity from unequal codes, corrected for codes that are equal by chance."""
    return (1 - unequal / (ROWS * rules.bands) - CHANCE) / (1 - CHANCE)


def _central_pairs(buckets: DataFrame) -> DataFrame:
    """``(a, b)``: every member of a bucket with the bucket's most central node."""
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    rows = buckets.join(weight, "node")
    first = F.max(F.struct("weight", (-F.col("node")).alias("node")))
    lead = rows.groupBy("key").agg((-first["node"]).alias("b"))
    return buckets.join(lead, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are alike enough."""
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(one, "a").join(other, "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    sizes = (F.size("x") + F.size("y")).cast("bigint")
    return both.filter(100 * common >= rules.percent * (sizes - common)).select("a", "b")


def _chunked(rows: DataFrame, chunks: Column) -> DataFrame:
    """Copies of bucket members for every pair of chunks ``(key, c, d)`` they are compared in."""
    chunks = F.greatest(chunks, F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))
    spread = rows.withColumn("__chunks", chunks).withColumn("__own", own).withColumn("__other", other)
    return spread.withColumns(
        {"c": F.least("__own", "__other"), "d": F.greatest("__own", "__other")}
    ).drop("__chunks", "__other")


def _groups(frames):
    """Whole groups of (key, c, d) from batches in that order."""
    import pandas as pd  # here, as most tasks do without it

    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        new = (frame[["key", "c", "d"]].shift() != frame[["key", "c", "d"]]).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield frame.iloc[a:b]
        rest = frame.iloc[starts[-1] :] if len(starts) else None
    if rest is not None and len(rest):
        yield rest


def _unequal_codes(planes: np.ndarray, one: np.ndarray, rules: NearRules) -> np.ndarray:
    apart = (planes ^ one).view(np.uint64)  # of signed numbers the bits of the absolute value are counted
    return np.bitwise_count(apart[:, : rules.words] | apart[:, rules.words :]).sum(axis=1)


def _open_rows(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, each set of members once."""
    mine = F.coalesce("component", "node")
    rows = buckets.filter("n > 2").join(found, "node", "left").select("key", "node", "n", mine.alias("comp"))
    rows = stored(rows, "buckets")
    mixed = (
        rows.groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("who"))
        .filter("low <> high")
        .groupBy("who", "m")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    return stored(rows.join(mixed, "key"), "buckets")


def _promising(rows: DataFrame, planes: DataFrame, rules: NearRules) -> DataFrame:
    """The members with a candidate of another component in their bucket."""

    def run(frames):
        import pandas as pd

        for g in _groups(frames):
            node, comp = g["node"].to_numpy(), g["comp"].to_numpy()
            codes = np.stack(g["planes"].to_list()).astype(np.int64)
            hit = np.zeros(len(g), dtype=bool)
            for i in range(len(g)):
                near = (_unequal_codes(codes, codes[i], rules) <= rules.most_unequal) & (comp != comp[i])
                hit[i] = near.any()
            yield pd.DataFrame({"key": g["key"].to_numpy()[hit], "node": node[hit]})

    parted = _chunked(rows.join(planes, "node"), F.ceil(F.col("n") / rules.chunk))
    spread = _in_order(parted.select("key", "c", "d", "node", "comp", "planes"))
    return spread.mapInPandas(run, "key bigint, node bigint").distinct()


def _joining(rows: DataFrame, planes: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Links ``(a, b)`` that join components within a bucket's chunks, checked on full sets."""

    def run(frames):
        import pandas as pd

        for g in _groups(frames):
            node = g["node"].to_numpy()
            _, label = np.unique(g["comp"].to_numpy(), return_inverse=True)
            codes = np.stack(g["planes"].to_list()).astype(np.int64)
            members = [np.asarray(m, dtype=np.int64) for m in g["members"]]
            links = []
            for i in range(len(g)):
                near = _unequal_codes(codes, codes[i], rules) <= rules.most_unequal
                for j in np.flatnonzero(near & (np.arange(len(g)) < i)):
                    if label[i] == label[j]:
                        continue
                    common = len(np.intersect1d(members[i], members[j], assume_unique=True))
                    if 100 * common >= rules.percent * (len(members[i]) + len(members[j]) - common):
                        label[label == label[j]] = label[i]
                        links.append((node[i], node[j]))
            yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    sizes = sets.select("node", F.size("members").alias("size"))
    heavy = rows.join(sizes, "node").groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    full = rows.join(planes, "node").join(sets, "node").join(heavy, "key")
    parted = _chunked(full, F.ceil(F.greatest(F.col("m") / rules.chunk, F.col("size") / rules.chunk_shingles)))
    spread = _in_order(parted.select("key", "c", "d", "node", "comp", "planes", "members"))
    return spread.mapInPandas(run, "a bigint, b bigint")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d", "node")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: NearRules = NearRules()
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    ``component_id`` is the least id that links lead to; ``kept`` marks the
    document that has it.  NULL and empty texts have no shingles and no links;
    texts of fewer words than a shingle are one shingle; a row with a NULL id is
    kept and linked with nothing; rows that share an id are one node with the
    links of all of them; an empty table gives no rows; other columns are not
    read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(signatures(rows, rules), "signatures")
    named = signed.filter("doc_id IS NOT NULL AND n > 0")
    nodes = stored(
        named.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("planes").alias("planes")
        ),
        "nodes",
    )
    links = _links(rows, signed, nodes, rules)
    found = components(links)

    classes = nodes.select("digest", "node").join(found, "node", "left")
    classes = stored(classes.select("digest", F.coalesce("component", "node").alias("component_id")), "classes")
    named_class = signed.select("doc_id", "n", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named_class.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _links(rows: DataFrame, signed: DataFrame, nodes: DataFrame, rules: NearRules) -> DataFrame:
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(banded.join(shared, "key"), "buckets")
    planes = nodes.select("node", "planes")

    pairs = _central_pairs(buckets)
    one = planes.select(F.col("node").alias("a"), F.col("planes").alias("x"))
    other = planes.select(F.col("node").alias("b"), F.col("planes").alias("y"))
    likely = pairs.join(one, "a").join(other, "b").filter(
        estimate(_unequal("x", "y", rules), rules) >= rules.least_estimate
    )
    likely = stored(likely.select("a", "b"), "pairs")
    ids = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = stored(_linked(likely, _sets_of(ids, rows, nodes, rules), rules), "links")

    still = _open_rows(buckets, components(links))
    again = stored(_promising(still, planes, rules), "buckets")
    members = still.join(again, ["key", "node"])
    sets = _sets_of(again.select("node").distinct(), rows, nodes, rules)
    return stored(links.unionByName(_joining(members, planes, sets, rules)), "links")


def _sets_of(ids: DataFrame, rows: DataFrame, nodes: DataFrame, rules: NearRules) -> DataFrame:
    """The full sets of some nodes, from their documents' texts."""
    ids = stored(ids, "ids")
    known = F.broadcast(ids) if ids.count() <= rules.broadcast_rows else ids
    texts = rows.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return stored(full_sets(texts, rules), "sets").filter("size(members) > 0")


def op1_near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns for shingles of three words and 85 percent."""
    return near_duplicates(docs, rules=NearRules(shingle=3, percent=85))


def one_of_each(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component.

    Documents are told apart by doc_id and text, so texts that share an id are
    compared one by one, and rows without an id like any other.  Rows alike in
    both are one document and one of them stays; of a component the one with
    the least id, NULL last.  Empty texts are near nothing.  All columns are
    kept, whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), F.col("doc_id").cast("bigint").alias("id"), "text")
    near = near_duplicates(rows.select("key", "text"), "key", rules=rules)
    classes = near.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"))
    ids = rows.groupBy("key").agg(F.min("id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    best = classes.join(ids, "key").groupBy("component").agg(F.min(order).alias("best")).select("best.key")
    own = Window.partitionBy("key").orderBy("key")
    left = rows.drop("id", "text").join(best, "key", "left_semi")
    left = left.withColumn("place", F.row_number().over(own)).filter("place = 1")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
