"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose score is above a cutoff.  A cutoff may be
used in a stratum only if the labelled good documents of the stratum show that
it rejects at most ``alpha`` of the good ones: the hypothesis "more than alpha
are rejected" must fail an exact binomial test at ``delta`` divided by the
number of all tests made (Bonferroni).  Of the certified cutoffs of a rule the
lowest is used; a rule or stratum without one rejects nothing.  The cutoffs
tried are fixed beforehand, so all labelled documents are the holdout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import WORD, stored

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where a lambda would compute it per element."""
    return F.transform(F.array(value), body)[0]


def _pairing(reach: int):
    """The hash of each element with the one ``reach`` places on."""

    def paired(hashes: Column) -> Column:
        n = F.size(hashes) - reach
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, reach + 1, n), lambda a, b: F.xxhash64(a, b))

    return paired


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        steps = F.transform(
            starts,
            lambda at, k: F.when(k < last, F.least(F.get(starts, k + 1) - at, F.lit(WINDOW))).otherwise(WINDOW),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        def twice(pair: Column, k: Column) -> Column:
            before, after = F.get(pairs, k - 1)["h"], F.get(pairs, k + 1)["h"]
            return F.coalesce(pair["h"] == before, F.lit(False)) | F.coalesce(pair["h"] == after, F.lit(False))

        starts = F.transform(F.filter(pairs, twice), lambda pair: pair["i"])
        return _let(F.sort_array(starts), covered)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.sort_array(pairs), repeated)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns of ``STATISTICS``, counted over the whole text; NULL counts as empty.

    A window's hash is made by doubling: of two words, of two pairs, of two
    fours, so that it costs three steps whatever the window.  Lines are cut at ``\\n`` and count only with a word in them.  Columns of
    these names are replaced; the others are kept.  One pass, no shuffle.
    """
    kept = [c for c in df.columns if c not in STATISTICS]
    text = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    words = text.select(*kept, "__text", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)).alias("__words"))
    windows = F.transform("__words", lambda w: F.xxhash64(w))
    for reach in (1, 2, 4):  # WINDOW is 8
        windows = _let(windows, _pairing(reach))
    parts = words.select(
        *kept,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.filter(F.split("__text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD))).alias("__lines"),
        F.when(F.size("__words") >= WINDOW, windows).alias("__windows"),
    )
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return parts.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("__windows").isNotNull() & some, _repeated_words(F.col("__windows")))
        .otherwise(0)
        .cast("bigint")
        .alias("n_repeat_words"),
    )


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """A score over the statistics, and the cutoffs that may be chosen, in ascending order."""

    name: str
    score: Column
    cutoffs: Sequence[float]


def default_rules() -> list[Rule]:
    shares = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]
    return [
        Rule("symbols", _ratio("n_symbols", "word_chars"), shares),
        Rule("dup_lines", _ratio("n_dup_lines", "n_lines"), shares),
        Rule("repeats", _ratio("n_repeat_words", "n_words"), shares),
        Rule("long_words", _ratio("word_chars", "n_words"), [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
        Rule("short_words", -_ratio("word_chars", "n_words"), [-4.5, -4.25, -4.0, -3.75, -3.5, -3.0, -2.5, -2.0, -1.5, -1.0]),
    ]


@dataclass(frozen=True)
class Risk:
    """At most ``alpha`` of a stratum's good documents fall to a rule, with confidence 1 - delta for all."""

    alpha: float = 0.005
    delta: float = 0.05


def _surely_below(n: Column, x: Column, alpha: float, level: Column) -> Column:
    """Whether P(Bin(n, alpha) <= x) <= level, summed exactly over its terms in logarithms."""
    start = F.struct((n * F.log1p(F.lit(-alpha))).alias("term"), F.lit(0.0).alias("sum"))
    odds = F.log(F.lit(alpha / (1 - alpha)))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), x),
        start,
        lambda acc, k: F.struct(
            (acc["term"] + F.log((n - k) / (k + 1)) + odds).alias("term"),
            (acc["sum"] + F.exp(acc["term"])).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    # From the mean up the sum is over a third, above any level in use.
    return F.when(x < n * alpha, total <= level).otherwise(False)


def certified_cutoffs(
    good: DataFrame, stratum: str, rules: Sequence[Rule] | None = None, risk: Risk = Risk()
) -> DataFrame:
    """``(stratum, cutoffs map<rule, cutoff>)`` from the statistics of labelled good documents.

    NULL strata form a stratum.  Counts are summed before the shuffle, one wide
    row per stratum and task, so a hot stratum costs no more than another.
    """
    rules = default_rules() if rules is None else rules
    above = [
        F.sum(F.when(rule.score > cutoff, 1).otherwise(0)).alias(f"{i}_{j}")
        for i, rule in enumerate(rules)
        for j, cutoff in enumerate(rule.cutoffs)
    ]
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *above)
    tests = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(float(cutoff)).alias("cutoff"),
            F.coalesce(f"{i}_{j}", F.lit(0)).cast("bigint").alias("x"),
        )
        for i, rule in enumerate(rules)
        for j, cutoff in enumerate(rule.cutoffs)
    ]
    strata = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    level = F.lit(risk.delta) / (F.col("strata") * len(tests))
    table = counts.select("stratum", "n", F.explode(F.array(*tests)).alias("t")).join(F.broadcast(strata))
    passed = table.filter(_surely_below(F.col("n"), F.col("t.x"), risk.alpha, level))
    lowest = passed.groupBy("stratum", F.col("t.rule").alias("rule")).agg(F.min("t.cutoff").alias("cutoff"))
    pairs = F.collect_list(F.struct("rule", "cutoff"))  # one per rule
    return lowest.groupBy("stratum").agg(F.map_from_entries(pairs).alias("cutoffs"))


def with_verdict(
    stats: DataFrame, cutoffs: DataFrame, stratum: str, rules: Sequence[Rule] | None = None
) -> DataFrame:
    """Add ``base_failed`` and ``kept``; rows of strata without cutoffs meet the base rule alone."""
    rules = default_rules() if rules is None else rules
    # A stratum's name as a struct is never NULL, so that NULL strata meet, too.
    left = stats.drop("base_failed", "kept").withColumn("__stratum", F.struct(F.col(stratum).alias("s")))
    right = cutoffs.select(F.struct(F.col("stratum").alias("s")).alias("__stratum"), F.col("cutoffs").alias("__cutoffs"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.lit(False)
    for rule in rules:
        over = rule.score > F.try_element_at(F.col("__cutoffs"), F.lit(rule.name))
        rejected = rejected | F.coalesce(over, F.lit(False))
    return (
        left.join(right, "__stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & ~rejected)
        .drop("__stratum", "__cutoffs")
    )


def good_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that every label calls good."""
    per_doc = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return per_doc.filter("quality = 1").select("doc_id")


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()
) -> DataFrame:
    """``(doc_id, stratum column, statistics, base_failed, kept)`` per row of ``docs``.

    Statistics are counted once and stored; calibration and verdict read them.
    NULL texts are empty and fail the base rule; NULL ids carry no label;
    repeated rows are judged alike; without labels the base rule stands alone;
    an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(stratum), "text")
    stats = stored(with_statistics(rows).drop("text"), "quality")
    good = stats.join(good_labels(labels), "doc_id", "left_semi")
    return with_verdict(stats, certified_cutoffs(good, stratum, risk=risk), stratum)


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, strata by language."""
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, as they are.

    Rows are stored once with their statistics.  Calibration reads those alone
    and joins them with the labels; the verdict is taken where a row is, so no
    text is shuffled.
    """
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    narrow = [F.col("doc_id").cast("bigint").alias("__doc"), F.col(stratum).alias("__s")]
    rows = stored(with_statistics(docs.select(own, F.col("text"), *narrow)).drop("text"), "quality")
    good = good_labels(labels).withColumnRenamed("doc_id", "__doc")
    labelled = rows.drop("__row").join(good, "__doc", "left_semi")
    cutoffs = stored(certified_cutoffs(labelled, "__s", risk=risk), "cutoffs")
    return with_verdict(rows, cutoffs, "__s").filter("kept").select("__row.*")
