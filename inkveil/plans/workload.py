"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.names import accepted, suffix
from inkveil.functions.rules import (
    DEFAULT_LABELS,
    PATTERNS,
    build_rules,
    detector_rules,
    rules_frame,
    rules_from_form,
)
from inkveil.operators import ledger
from inkveil.operators.detect import corpus_totals, detect, long_counts, summary_text
from inkveil.operators.keywords import detect_keywords, redact_keywords
from inkveil.operators.manifest import dedup_inputs, input_manifest, last_write_wins
from inkveil.operators.naming import output_names
from inkveil.operators.redact import redact
from inkveil.operators.rulesets import RuleSets
from inkveil.operators.spans import redaction_spans
from inkveil.plans.jobs import (
    job_documents,
    job_runs,
    job_status,
    latest_progress,
    live_progress,
    log_tail,
    purge_runs,
    submit,
    submit_all,
)
from inkveil.plans.layout import INPUT_PARTITIONS, dealt, spread
from inkveil.plans.run import preview_sources, redact_sources, store_run
from inkveil.plans.scratch import scratch_path
from inkveil.plans.totals import incremental_totals, update_totals
from inkveil.sources.export import export_runs, exported_bundle, exported_texts
from inkveil.sources.extract import html_to_markdown
from inkveil.sources.files import decode_text, scan_text_files
from inkveil.sources.outputs import bundle_manifest, export_files, read_outputs, write_outputs
from inkveil.streaming.redact_stream import named_outputs, redact_stream, start_named, start_table

Query = Callable[[SparkSession, str], DataFrame]

DETECTOR_KEYS = {
    "email": "Email addresses",
    "phone": "Phone numbers",
    "ssn": "Social Security Numbers",
    "ein": "Employer Identification Numbers (EINs)",
    "card": "Credit card numbers",
    "ip": "IP addresses",
    "date": "Dates (MM/DD/YYYY etc.)",
    "passport": "US Passport numbers",
    "url": "URLs",
    "iban": "Bank / IBAN numbers",
    "zip": "ZIP / Postal codes",
}
# Parameters of the queries, shared with the SQL they are checked against.
REORDERED = ("Credit card numbers", "ZIP / Postal codes", "Phone numbers", "Email addresses")
REQUESTED = ("IP addresses", "No such detector", "Email addresses", "IP addresses")
KEYWORDS = ("the", "token", "&&&", "es")
WHOLE_WORDS = ("the", "token", "of it")
CASED_WORDS = ("The", "Token")
EXPRESSIONS = (r"[a-z]+tion[.,]", r"[&#$%*]{3}")
PYTHON_EXPRESSIONS = (r"(?P<word>[a-z]+)ing\b", r"(?:er|he)+n")
LOOKUP_RUN = "src7"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text with every kind of sensitive value, derived from each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    asked = spark.conf.get(INPUT_PARTITIONS, None)
    rows = spread(orders, "o_orderkey") if asked else dealt(orders, *orders.columns)
    return rows.selectExpr(
        "o_orderkey",
        """concat_ws(' ',
            'mail', concat('user', o_custkey, '@example.com'),
            'tel', concat('(555) 010-', lpad(cast(o_orderkey % 10000 as string), 4, '0')),
            'ssn', concat(lpad(cast(o_custkey % 1000 as string), 3, '0'), '-12-',
                          lpad(cast(o_orderkey % 10000 as string), 4, '0')),
            'ein', concat('12-', lpad(cast(o_orderkey as string), 7, '0')),
            'card', concat('4000 0000 ', lpad(cast(o_custkey % 10000 as string), 4, '0'), ' ',
                           lpad(cast(o_orderkey % 10000 as string), 4, '0')),
            'ip', concat('10.0.', o_orderkey % 256, '.', o_custkey % 256),
            'on', date_format(o_orderdate, 'MM/dd/yyyy'),
            'pp', concat('X', lpad(cast(o_orderkey as string), 8, '0')),
            concat('(https://example.com/o/', o_orderkey, ')'),
            concat('GB29', lpad(cast(o_orderkey as string), 16, '0')),
            'zip', lpad(cast(o_custkey % 100000 as string), 5, '0')) AS text""",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts at hand: (src, id, text)."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    parts = [
        documents(spark, sf_dir).selectExpr("'documents' AS src", "doc_id AS id", "text"),
        turns.selectExpr("'conversations' AS src", "conv_id * 1000 + turn AS id", "text"),
        pages.selectExpr("'pages' AS src", "page_id AS id", "html AS text"),
        dense(spark, sf_dir).selectExpr("'orders' AS src", "o_orderkey AS id", "text"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listed files: a run per source, few names, some of them unreadable."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ending = "element_at(array('.txt', '.md', '.TXT', '.pdf'), cast(doc_id % 4 + 1 as int))"
    return docs.selectExpr(
        "source AS run_id", "doc_id AS seq", f"concat(lang, ' report', {ending}) AS name", "text"
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages as files: (run_id, seq, name, content)."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    listed = spread(document_names(spark, sf_dir), "seq")
    return listed.selectExpr("run_id", "seq", "name", "cast(text AS binary) AS content").unionAll(
        pages.selectExpr(
            "'pages' AS run_id",
            "page_id AS seq",
            "concat('page ', page_id % 100, '.html') AS name",
            "cast(html AS binary) AS content",
        )
    )


def _detect_one(label: str) -> Query:
    def query(spark, sf_dir):
        found = detect(texts(spark, sf_dir), detector_rules([label]))
        return long_counts(found, ["src", "id"]).select("src", "id", "n")

    return query


def _detect_counts(spark, sf_dir):
    return long_counts(detect(documents(spark, sf_dir), detector_rules()), ["doc_id"])


def _detect_counts_all(spark, sf_dir):
    return long_counts(detect(texts(spark, sf_dir), detector_rules()), ["src", "id"])


def _detect_summary(spark, sf_dir):
    found = detect(texts(spark, sf_dir), detector_rules())
    return found.select("src", "id", summary_text(F.col("matches")).alias("summary"))


def _detector_catalog(spark, sf_dir):
    rules = detector_rules()
    totals = corpus_totals(documents(spark, sf_dir), rules, []).drop("label")
    joined = rules_frame(spark, rules).join(totals, "rule_no", "left")
    return joined.select(
        "rule_no",
        "label",
        "pattern",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def _corpus_totals(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return corpus_totals(docs, detector_rules(), ["lang", "source"])


def _redacted(source: Callable, key: str, rules: Callable, style: str) -> Query:
    def query(spark, sf_dir):
        done = redact(source(spark, sf_dir), rules(), style)
        return done.select(key, "redacted", "n_redacted")

    return query


def _redact_count(spark, sf_dir):
    done = redact(texts(spark, sf_dir), detector_rules(), matches_into="matches")
    total = F.aggregate("matches", F.lit(0), lambda n, m: n + m["n"])
    return done.select("src", "id", total.alias("n_detected"), "n_redacted")


def _redact_all(spark, sf_dir):
    done = redact(texts(spark, sf_dir), detector_rules(), "box")
    return done.select("src", "id", "redacted", "n_redacted")


def _redaction_spans(spark, sf_dir):
    found = redaction_spans(texts(spark, sf_dir), detector_rules(), "box")
    return found.select("src", "id", "rule_no", F.col("start").alias("begin"), F.col("end").alias("stop"))


def _source_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS seq", "url AS name")
    names = document_names(spark, sf_dir).select("seq", "name").unionAll(pages)
    name = F.col("name")
    return names.select("seq", "name", suffix(name).alias("suffix"), accepted(name).alias("accepted"))


def _extract_html(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", html_to_markdown(F.col("html")).alias("text"))


def _scan_text_decode(spark, sf_dir):
    """Texts as bytes with a foreign line end, a lone CR and a malformed byte."""
    whole = texts(spark, sf_dir)
    content = F.expr("concat(cast(text AS binary), X'0D0A61FF0D', cast(src AS binary))")
    return whole.select("src", "id", decode_text(content).alias("text"))


def _scan_text_files(spark, sf_dir):
    """Conversation turns exported as files, then read back."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    named = turns.selectExpr("concat('turn ', conv_id, ' ', turn, '.MD') AS output", "text AS markdown")
    folder = scratch_path(spark, "text-files")
    export_files(named, folder, keys=()).write.format("noop").mode("overwrite").save()
    return scan_text_files(spark, folder).select("name", "text")


def _export_runs(spark, sf_dir):
    """Every run's outputs as files in a folder of its own, read back by their manifest."""
    folder = scratch_path(spark, "exported")
    export_runs(_run(spark, sf_dir, "label").filter("error IS NULL"), folder)
    return exported_texts(spark, folder)


def _exported_bundle(spark, sf_dir):
    folder = scratch_path(spark, "exported")
    export_runs(_run(spark, sf_dir, "box").filter("error IS NULL"), folder)
    return exported_bundle(spark, folder, LOOKUP_RUN)


def _input_manifest(spark, sf_dir):
    """Listed names: page addresses, and documents of which some have no name."""
    pages = table(spark, sf_dir, "pages").selectExpr("'pages' AS src", "page_id AS seq", "url AS name")
    docs = table(spark, sf_dir, "documents").selectExpr(
        "'documents' AS src",
        "doc_id AS seq",
        "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN NULL"
        " ELSE concat(' ../', source, '/My  ', lang, ' (', n_chars, ').txt ') END AS name",
    )
    return input_manifest(pages.unionAll(docs)).select("src", "seq", "safe_name")


def _last_write_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    listed = docs.selectExpr(
        "doc_id AS seq", "IF(lang = 'de', NULL, concat(lang, '_', source)) AS name", "text"
    )
    return last_write_wins(listed, ["name"], "seq", ["text"])


def _dedup_inputs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    listed = turns.selectExpr(
        "nullif(role, 'system') AS name",
        "IF(conv_id % 3 = 0, NULL, length(text)) AS size",
        "conv_id * 1000 + turn AS seq",
    )
    return dedup_inputs(listed)


def _named_documents(spark, sf_dir):
    return document_names(spark, sf_dir).selectExpr("run_id", "seq", "name", "name NOT LIKE '%.pdf' AS ok")


def _output_names(spark, sf_dir):
    named = output_names(_named_documents(spark, sf_dir), ["run_id"], ok="ok")
    return named.select("run_id", "seq", "output")


def _output_names_existing(spark, sf_dir):
    """The same names in folders that hold files already (one per label row)."""
    taken = table(spark, sf_dir, "labels").selectExpr(
        "concat('src', doc_id % 20) AS run_id",
        "concat(element_at(array('en', 'fr', 'de', 'es'), cast(doc_id % 4 + 1 as int)),"
        " ' report_redacted', IF(doc_id div 80 % 7 = 0, '', concat('_', doc_id div 80 % 7 + 1)),"
        " '.md') AS output",
    )
    named = output_names(_named_documents(spark, sf_dir), ["run_id"], ok="ok", existing=taken)
    return named.select("run_id", "seq", "output")


def _run(spark, sf_dir, style="label"):
    return redact_sources(files(spark, sf_dir), detector_rules(), style)


def _redact_sources(spark, sf_dir):
    return _run(spark, sf_dir).select(
        "run_id", "seq", "output", F.col("error").isNull().alias("ok"), "n_redacted", "markdown"
    )


def _scan_preview(spark, sf_dir):
    found = preview_sources(files(spark, sf_dir), detector_rules())
    return found.select("run_id", "seq", summary_text(F.col("matches")).alias("summary"))


def _write_outputs(spark, sf_dir):
    done = _run(spark, sf_dir, "box").filter("error IS NULL")
    path = scratch_path(spark, "outputs")
    write_outputs(done, path)
    return read_outputs(spark, path)


def _stored(spark, sf_dir, style="label"):
    return store_run(_run(spark, sf_dir, style), scratch_path(spark, "run"))


def _bundle_manifest(spark, sf_dir):
    return bundle_manifest(_stored(spark, sf_dir, "box").documents, "pages")


def _run_activity(spark, sf_dir):
    return _stored(spark, sf_dir).activity


def _number(source: str = "source") -> str:
    """The number in a source's name, 0 without one."""
    return f"coalesce(try_cast(regexp_extract({source}, '([0-9]+)', 1) AS int), 0)"


def _listing(spark, sf_dir):
    """All documents as listed files, a job per source; some have no usable name."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    return spread(docs, "doc_id").selectExpr(
        "source AS run_id",
        "doc_id AS seq",
        "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN '..'"
        " ELSE concat(' ', lang, '/', doc_id % 40, IF(doc_id % 5 = 0, '.pdf', '.txt')) END AS name",
        "cast(text AS binary) AS content",
    )


def _jobs(spark, sf_dir):
    """A job per source, all with the whole catalog."""
    labels = F.array(*map(F.lit, PATTERNS))
    sources = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("run_id"))
    return sources.distinct().select("run_id", labels.alias("labels"), F.lit("label").alias("style"))


def _submitted(spark, sf_dir):
    """All documents as jobs by source, and one job that breaks off as a whole."""
    root = scratch_path(spark, "jobs")
    submit_all(_listing(spark, sf_dir), _jobs(spark, sf_dir), root)
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "'a.txt' AS name", "cast(text AS binary) AS content")
    lost = F.when(F.col("seq").isNotNull(), F.raise_error(F.lit("disk full"))).otherwise(F.col("content"))
    submit(docs.withColumn("content", lost), detector_rules(), root, "broken", "label")
    return root


def _submit_run(spark, sf_dir):
    documents = job_documents(spark, _submitted(spark, sf_dir)).documents
    return documents.select("run_id", "seq", "name", "output", "n_redacted", "markdown")


def _run_outcome(spark, sf_dir):
    root = _submitted(spark, sf_dir)
    said = ledger.run_outcome(job_runs(spark, root), job_documents(spark, root).results)
    # An error's code stands behind its message.
    return said.select("run_id", "status", F.regexp_replace("sentence", " SQLSTATE.*$", "").alias("sentence"))


def _job_status(spark, sf_dir):
    told = job_status(spark, _submitted(spark, sf_dir))
    told = told.withColumn("error", F.regexp_replace("error", " SQLSTATE.*$", ""))
    return told.select("run_id", "status", "error", "current", "total", "n_ok", "n_failed")


SLICES = 3


def _in_slices(spark, sf_dir):
    root = scratch_path(spark, "jobs")
    submit_all(_listing(spark, sf_dir), _jobs(spark, sf_dir), root, slices=SLICES)
    return root


def _live_progress(spark, sf_dir):
    """Where all jobs stand by the stream of their stored documents."""
    root, path, checkpoint = _in_slices(spark, sf_dir), scratch_path(spark, "lines"), scratch_path(spark, "progress")
    live_progress(spark, root, path, checkpoint).awaitTermination()
    return latest_progress(spark, path)


TAIL_FROM = 40


def _log_tail(spark, sf_dir):
    return log_tail(spark, _in_slices(spark, sf_dir), LOOKUP_RUN, TAIL_FROM)


def _purge_runs(spark, sf_dir):
    """Jobs by source, each ten minutes older than the one before it; what a purge takes and leaves."""
    root = scratch_path(spark, "jobs")
    now = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    aged = _jobs(spark, sf_dir).withColumn("created", F.lit(now) - F.expr(f"make_dt_interval(0, 0, 10 * {_number('run_id')})"))
    submit_all(_listing(spark, sf_dir), aged, root)
    removed = purge_runs(spark, root, now).filter("removed").select("run_id", F.lit(True).alias("removed"))
    left = job_documents(spark, root).documents.groupBy("run_id").agg(F.count("*").alias("n_left"))
    kept = job_runs(spark, root).select("run_id", F.lit(False).alias("removed"))
    return removed.unionAll(kept).join(left, "run_id", "left").select(
        "run_id", "removed", F.coalesce("n_left", F.lit(0)).alias("n_left")
    )


ADDED = " and call 555-010-1234."


def _incremental_totals(spark, sf_dir):
    """Totals after all jobs ran, every third ran again with longer texts, and old ones were purged."""
    root, path = scratch_path(spark, "jobs"), scratch_path(spark, "totals")
    now = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    aged = _jobs(spark, sf_dir).withColumn("created", F.lit(now) - F.expr(f"make_dt_interval(0, 0, 10 * {_number('run_id')})"))
    submit_all(_listing(spark, sf_dir), aged, root)
    update_totals(spark, root, path)
    again = aged.filter(F.expr(f"{_number('run_id')} % 3 = 0")).withColumn("created", F.lit(now))
    longer = F.concat("content", F.lit(ADDED).cast("binary"))
    submit_all(_listing(spark, sf_dir).withColumn("content", longer), again, root)
    purge_runs(spark, root, now)
    update_totals(spark, root, path)
    return incremental_totals(spark, path)


# Options by number of source, and the words from which keyword tables are taken.
OPTION_SETS = (
    {"labels": ["Email addresses", "Phone numbers"], "style": "box"},
    {"labels": [], "keywords": list(WHOLE_WORDS), "whole_word": True, "style": "label"},
    {"labels": ["IP addresses", "Credit card numbers"], "keywords": ["Und", "The"], "case_sensitive": True, "style": "box"},
    {"labels": [], "keywords": ["&&&", "on"], "expressions": [r"[a-z]+tion[.,]"], "style": "label"},
    {"labels": list(DEFAULT_LABELS), "expressions": [r"[&#$%*]{3}"], "style": "label"},
    {"labels": ["URLs", "ZIP / Postal codes", "Phone numbers"], "keywords": ["redacted", "er"], "style": "label"},
)
OPTIONS_DDL = "set int, labels array<string>, keywords array<string>, expressions array<string>, case_sensitive boolean, whole_word boolean, style string"
KEYWORD_LETTERS = 6


def _multi_job_redact(spark, sf_dir):
    """All documents, each source by its own job's selection, keywords, flags and style."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    names = OPTIONS_DDL.replace(",", "").split()[::2]
    options = spark.createDataFrame([(i, *[o.get(n) for n in names[1:]]) for i, o in enumerate(OPTION_SETS)], OPTIONS_DDL)
    sources = docs.select("source").filter("source IS NOT NULL").distinct()
    jobs = sources.withColumn("set", F.expr(f"{_number()} % {len(OPTION_SETS)}")).join(F.broadcast(options), "set").drop("set")
    return RuleSets(jobs, "source").redact(docs).select("doc_id", "redacted", "n_redacted")


def _keyword_table(spark, sf_dir):
    """Every longer word of ASCII letters in the conversations."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("keyword"))
    return words.filter(F.length("keyword") >= KEYWORD_LETTERS).distinct()


def _keyword_table_redact(spark, sf_dir):
    done = redact_keywords(
        documents(spark, sf_dir), _keyword_table(spark, sf_dir), "box", whole_word=True, order="keyword"
    )
    return done.select("doc_id", "redacted", "n_redacted")


def _keyword_table_totals(spark, sf_dir):
    """By keyword of the table, the documents and the matches."""
    found = detect_keywords(documents(spark, sf_dir), _keyword_table(spark, sf_dir), whole_word=True, order="keyword")
    listed = long_counts(found, ["doc_id"])
    return listed.groupBy("label").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_matches"))


def _expire_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr("event_id AS run_id", "ts AS created")
    return ledger.expire_runs(runs, runs.agg(F.max("created")).scalar())


def _run_lookup(spark, sf_dir):
    return ledger.find_run(_stored(spark, sf_dir).results, LOOKUP_RUN)


def _document_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    # As a pattern the name may be that of a file or of a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")


def _redact_stream(spark, sf_dir):
    stream = _document_stream(spark, sf_dir).select("doc_id", "text")
    done = redact_stream(stream, detector_rules(), "label").drop("text")
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    start_table(done, path, checkpoint).awaitTermination()
    return spark.read.schema(done.schema).parquet(path)


def _redact_stream_named(spark, sf_dir):
    stream = _document_stream(spark, sf_dir).selectExpr(
        "doc_id AS seq", "concat(lang, '.txt') AS name", "cast(text AS binary) AS content"
    )
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    start_named(stream, detector_rules(), path, checkpoint, "label").awaitTermination()
    return named_outputs(spark, path).select("seq", "output", "n_redacted", "markdown")


def _keywords(words, **flags):
    return lambda: rules_from_form((), "\n".join(words), **flags)


def _expressions(patterns):
    return lambda: rules_from_form((), "", "\n".join(patterns))


def registered() -> dict[str, Query]:
    """Name -> query."""
    on_docs = (documents, "doc_id")
    on_orders = (dense, "o_orderkey")
    return {
        "redact_label": _redacted(*on_docs, detector_rules, "label"),
        "redact_box": _redacted(*on_docs, detector_rules, "box"),
        "redact_label_dense": _redacted(*on_orders, detector_rules, "label"),
        "redact_box_dense": _redacted(*on_orders, detector_rules, "box"),
        "redact_all": _redact_all,
        "redaction_spans": _redaction_spans,
        "redact_defaults": _redacted(*on_orders, lambda: detector_rules(DEFAULT_LABELS), "box"),
        "redact_selection": _redacted(*on_orders, lambda: detector_rules(REQUESTED), "label"),
        "redact_order": _redacted(*on_orders, lambda: detector_rules(REORDERED), "label"),
        "redact_order_documents": _redacted(*on_docs, lambda: detector_rules(REORDERED), "label"),
        "redact_count": _redact_count,
        "redact_nested_marks": _redacted(
            *on_orders, lambda: build_rules(PATTERNS, ["redacted"]), "label"
        ),
        "keyword_redact": _redacted(*on_docs, _keywords(KEYWORDS), "box"),
        "whole_word_redact": _redacted(*on_docs, _keywords(WHOLE_WORDS, whole_word=True), "label"),
        "case_sensitive_redact": _redacted(
            *on_docs, _keywords(CASED_WORDS, case_sensitive=True), "box"
        ),
        "custom_regex_redact": _redacted(*on_docs, _expressions(EXPRESSIONS), "label"),
        "custom_regex_python": _redacted(*on_docs, _expressions(PYTHON_EXPRESSIONS), "box"),
        **{f"detect_{key}": _detect_one(label) for key, label in DETECTOR_KEYS.items()},
        "detector_catalog": _detector_catalog,
        "detect_counts": _detect_counts,
        "detect_counts_all": _detect_counts_all,
        "detect_summary": _detect_summary,
        "corpus_detect_totals": _corpus_totals,
        "source_gate": _source_gate,
        "scan_text_decode": _scan_text_decode,
        "scan_text_files": _scan_text_files,
        "extract_html": _extract_html,
        "scan_preview": _scan_preview,
        "input_manifest": _input_manifest,
        "last_write_wins": _last_write_wins,
        "dedup_inputs": _dedup_inputs,
        "output_names": _output_names,
        "output_names_existing": _output_names_existing,
        "redact_sources": _redact_sources,
        "write_outputs": _write_outputs,
        "bundle_manifest": _bundle_manifest,
        "run_results": lambda spark, d: ledger.run_results(_run(spark, d)),
        "run_summary": lambda spark, d: ledger.run_summary(ledger.run_results(_run(spark, d))),
        "run_progress": lambda spark, d: ledger.run_progress(
            files(spark, d).select("run_id", "seq")
        ),
        "activity_log": _run_activity,
        "expire_runs": _expire_runs,
        "run_lookup": _run_lookup,
        "export_runs": _export_runs,
        "exported_bundle": _exported_bundle,
        "multi_job_redact": _multi_job_redact,
        "keyword_table_redact": _keyword_table_redact,
        "keyword_table_totals": _keyword_table_totals,
        "purge_runs": _purge_runs,
        "live_progress": _live_progress,
        "incremental_totals": _incremental_totals,
        "log_tail": _log_tail,
        "submit_run": _submit_run,
        "run_outcome": _run_outcome,
        "job_status": _job_status,
        "redact_stream": _redact_stream,
        "redact_stream_named": _redact_stream_named,
    }
