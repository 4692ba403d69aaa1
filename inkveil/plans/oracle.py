"""SQL with the same results as the registered queries, for a second engine.

The statements are written for DuckDB over the same tables.  They share the
rule patterns and query parameters with the queries, and no logic.

DuckDB's ``\\b`` knows ASCII letters only.  Where that matters
(``redact_order_documents``: a card number before a space and an accented
letter), matches are looked for in a copy of the text in which every other
letter is an ``a`` and every other digit a ``0``, and cut out of the text by
their positions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from inkveil.functions.names import ACCEPTED_SUFFIXES
from inkveil.functions.rules import DEFAULT_LABELS, PATTERNS
from inkveil.plans import workload as w

DENSE = """(SELECT o_orderkey, concat_ws(' ',
    'mail', 'user' || o_custkey || '@example.com',
    'tel', '(555) 010-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'),
    'ssn', lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-12-'
           || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'),
    'ein', '12-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0'),
    'card', '4000 0000 ' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || ' '
           || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'),
    'ip', '10.0.' || o_orderkey % 256 || '.' || o_custkey % 256,
    'on', strftime(o_orderdate, '%m/%d/%Y'),
    'pp', 'X' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'),
    '(https://example.com/o/' || o_orderkey || ')',
    'GB29' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0'),
    'zip', lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0')) AS text FROM orders)"""

TEXTS = f"""(SELECT 'documents' AS src, doc_id AS id, text FROM documents
    UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
    UNION ALL SELECT 'pages', page_id, html FROM pages
    UNION ALL SELECT 'orders', o_orderkey, text FROM {DENSE})"""

NAMES = """(SELECT source AS run_id, doc_id AS seq,
    lang || ' report' || (['.txt', '.md', '.TXT', '.pdf'])[doc_id % 4 + 1] AS name, text
    FROM documents)"""

BOX = "█"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def count(text: str, pattern: str, flags: str = "i") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}, 0, '{flags}'))"


def rewrite(text: str, pattern: str, style: str, flags: str = "i") -> str:
    if style == "label":
        return f"regexp_replace({text}, {quoted(pattern)}, '[REDACTED]', 'g{flags}')"
    split = quoted(f"(?{flags})" + pattern) if flags == "i" else quoted(pattern)
    matches = f"regexp_extract_all({text}, {quoted(pattern)}, 0, '{flags}')"
    return (
        f"list_aggregate(list_transform(list_zip(string_split_regex({text}, {split}), {matches}),"
        f" lambda z: z[1] || coalesce(repeat('{BOX}', length(z[2])), '')), 'string_agg', '')"
    )


def chain(source: str, keys: str, patterns: Sequence[str], style: str, flags: str = "i") -> str:
    """Rules applied one after the other: keys, t, n."""
    steps = [f"t0 AS (SELECT {keys}, coalesce(text, '') AS t, 0 AS n FROM {source})"]
    for k, p in enumerate(patterns):
        steps.append(
            f"t{k + 1} AS (SELECT {keys}, {rewrite('t', p, style, flags)} AS t,"
            f" n + {count('t', p, flags)} AS n FROM t{k})"
        )
    return f"(WITH {', '.join(steps)} SELECT {keys}, t, n FROM t{len(patterns)})"


def redacted(source: str, key: str, patterns: Sequence[str], style: str, flags: str = "i") -> str:
    done = chain(source, key, patterns, style, flags)
    return f"SELECT {key}, t AS redacted, n::INTEGER AS n_redacted FROM {done}"


def of(labels: Sequence[str]) -> list[str]:
    return [PATTERNS[label] for label in dict.fromkeys(labels) if label in PATTERNS]


def spans(source: str, keys: str, patterns: Sequence[str]) -> str:
    """Where each rule's boxes lie; boxes are as long as what they cover, so places stay."""
    steps = [f"t0 AS (SELECT {keys}, coalesce(text, '') AS t FROM {source})"]
    parts = []
    for k, p in enumerate(patterns):
        steps.append(f"t{k + 1} AS (SELECT {keys}, {rewrite('t', p, 'box')} AS t FROM t{k})")
        steps.append(f"""s{k} AS (SELECT {keys},
            list_transform(string_split_regex(t, {quoted('(?i)' + p)}), lambda x: length(x)) AS gaps,
            list_transform(regexp_extract_all(t, {quoted(p)}, 0, 'i'), lambda x: length(x)) AS hits
            FROM t{k} WHERE regexp_matches(t, {quoted(p)}, 'i'))""")
        begin = "CAST(list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS BIGINT)"
        parts.append(
            f"SELECT {keys}, {k + 1}::INTEGER AS rule_no, {begin} AS begin, CAST({begin} + hits[i] AS BIGINT) AS stop"
            f" FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM s{k})"
        )
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(parts)}"


def words(keywords: Sequence[str], whole: bool = False) -> list[str]:
    edge = r"\b" if whole else ""
    return [edge + re.escape(k) + edge for k in keywords]


def counts(source: str, keys: str) -> str:
    """Long form of the counts on the original text."""
    parts = [
        f"SELECT {keys}, {no} AS rule_no, {quoted(label)} AS label,"
        f" {count('text', p)}::INTEGER AS n FROM {source}"
        for no, (label, p) in enumerate(PATTERNS.items(), start=1)
    ]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0)"


def summaries(source: str, keys: str) -> str:
    """One line per document in rule order, empty without matches."""
    pairs = [
        f"CASE WHEN {count('text', p)} > 0 THEN {quoted(label + ': ')} || {count('text', p)} END"
        for label, p in PATTERNS.items()
    ]
    return f"SELECT {keys}, concat_ws(', ', {', '.join(pairs)}) AS summary FROM {source}"


def by_position(source: str, key: str, patterns: Sequence[str]) -> str:
    """Labels put where the patterns match in a copy of the text with ASCII letters only."""
    letters = "regexp_replace(t, '[^\\x00-\\x7F\\P{L}]', 'a', 'g')"
    ascii_copy = f"regexp_replace({letters}, '[^\\x00-\\x7F\\P{{N}}]', '0', 'g')"
    steps = [f"t0 AS (SELECT {key}, coalesce(text, '') AS t, 0 AS n FROM {source})"]
    for k, p in enumerate(patterns):
        parts = f"""SELECT {key}, t, n,
            list_transform(string_split_regex({ascii_copy}, {quoted('(?i)' + p)}), lambda x: length(x)) AS gaps,
            list_transform(regexp_extract_all({ascii_copy}, {quoted(p)}, 0, 'i'), lambda x: length(x)) AS hits
            FROM t{k}"""
        begin = "coalesce(list_sum(gaps[1:i - 1]), 0) + coalesce(list_sum(hits[1:i - 1]), 0) + 1"
        piece = f"substring(t, CAST({begin} AS BIGINT), gaps[i])"
        steps.append(
            f"t{k + 1} AS (SELECT {key}, CASE WHEN len(hits) = 0 THEN t ELSE array_to_string("
            f"list_transform(range(1, len(gaps) + 1), lambda i: {piece}), '[REDACTED]') END AS t,"
            f" n + len(hits) AS n FROM ({parts}))"
        )
    return (
        f"WITH {', '.join(steps)} SELECT {key}, t AS redacted, n::INTEGER AS n_redacted"
        f" FROM t{len(patterns)}"
    )


def html_text(html: str) -> str:
    """A page as Markdown: parts without text, white space, blocks, other tags, references, blanks."""
    text = html

    def put(pattern: str, mark: str) -> None:
        nonlocal text
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(mark)}, 'g')"

    put("(?s)<!--.*?-->", "")
    for element in ("script", "style", "head"):
        put(rf"(?is)<{element}(?:\s[^>]*)?>.*?</{element}\s*>", "")
    put(r"\s+", " ")
    for level in range(1, 7):
        put(rf"(?i)<h{level}(?:\s[^>]*)?>", "\n\n" + "#" * level + " ")
    put(r"(?i)<li(?:\s[^>]*)?>", "\n- ")
    put(r"(?i)<br(?:[\s/][^>]*)?>", "\n")
    blocks = "address article aside blockquote div footer header main nav p section table"
    put(rf"(?i)</?(?:{'|'.join(blocks.split())})(?:\s[^>]*)?>", "\n\n")
    put(r"(?i)</(?:h[1-6]|ol|ul)\s*>", "\n\n")
    put(r"(?i)</?(?:dd|dt|tr)(?:\s[^>]*)?>", "\n")
    put(r"(?i)</t[dh]\s*>", " ")
    put(r"</?[a-zA-Z][^>]*>|<[!?][^>]*>", "")
    signs = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "copy": "©", "middot": "·"}
    for name, sign in signs.items():
        text = f"replace({text}, '&{name};', {quoted(sign)})"
    text = f"replace({text}, '&amp;', '&')"
    put("[ \t]+", " ")
    put(" ?\n ?", "\n")
    put("\n\n\n+", "\n\n")
    return f"trim({text}, ' ' || chr(10))"


SUFFIX = r"lower(regexp_extract(name, '(?s)^.+(\.[^.]+)\z', 1))"
STEM = r"regexp_replace(name, '(?s)^(.+)\.[^.]+\z', '\1')"
NEWLINES = r"regexp_replace({}, '\r\n?', chr(10), 'g')"

# Documents and pages as extracted files; a .pdf has no extractor.
FILES = f"""(SELECT run_id, seq, name, {NEWLINES.format('text')} AS text,
        CASE WHEN name LIKE '%.pdf' THEN 'No extractor for ''.pdf''' END AS error FROM {NAMES}
    UNION ALL SELECT 'pages', page_id, 'page ' || page_id % 100 || '.html',
        {html_text(NEWLINES.format('html'))}, NULL FROM pages)"""


def named(source: str, good: str) -> str:
    """run_id, seq, output over run_id, seq, name."""
    return f"""(SELECT run_id, seq, CASE WHEN ok THEN stem || '_redacted'
            || CASE WHEN nth = 1 THEN '' ELSE '_' || nth END || '.md' ELSE '' END AS output
        FROM (SELECT *, {STEM} AS stem, {good} AS ok,
                row_number() OVER (PARTITION BY run_id, {STEM}, {good} ORDER BY seq) AS nth
            FROM {source}))"""


RUN_NAMES = named(FILES, "error IS NULL")


def run(style: str, files: str = FILES) -> str:
    """The documents of a run."""
    done = chain(files, "run_id, seq, name, error", list(PATTERNS.values()), style)
    return f"""(SELECT d.run_id, d.seq, d.name, o.output, d.error,
            CASE WHEN d.error IS NULL THEN d.t END AS markdown,
            CASE WHEN d.error IS NULL THEN d.n ELSE 0 END::INTEGER AS n_redacted
        FROM {done} d JOIN {named(files, 'error IS NULL')} o USING (run_id, seq))"""


RESULTS = f"""(SELECT f.run_id, f.seq, f.name AS input, o.output, f.error IS NULL AS ok
    FROM {FILES} f JOIN {RUN_NAMES} o USING (run_id, seq))"""

PLACES = """row_number() OVER (PARTITION BY run_id ORDER BY seq) AS current,
    count(*) OVER (PARTITION BY run_id) AS total"""


def activity(files: str = FILES) -> str:
    line = "SELECT run_id, seq, {} AS line_no, {} AS line FROM a"
    bad = "SELECT run_id, seq, {} AS line_no, {} AS line FROM a WHERE error IS NOT NULL"
    good = "SELECT run_id, seq, {} AS line_no, {} AS line FROM a WHERE error IS NULL"
    shift = "CASE WHEN error IS NULL THEN 0 ELSE 1 END"
    rows = [
        line.format("1", "'[' || current || '/' || total || '] Scanning ' || name || '...'"),
        bad.format("2", "'  (preview failed for ' || name || ': ' || error || ')'"),
        line.format(
            f"2 + {shift}",
            "CASE WHEN summary <> '' THEN '  Detected -> ' || summary"
            " ELSE '  No matches in preview (Markdown export still runs).' END",
        ),
        line.format(f"3 + {shift}", "'  Redacting ' || name || '...'"),
        good.format("4", "'  MARKDOWN: ' || n_redacted || ' match(es) redacted.'"),
        bad.format("5", "'  ERROR redacting ' || name || ': ' || error"),
        good.format("5", "'  Saved -> ' || output"),
        bad.format("6", "'  FAILED: ' || error"),
    ]
    readable = f"(SELECT run_id, seq, CASE WHEN error IS NULL THEN text ELSE '' END AS text FROM {files})"
    return f"""WITH a AS (SELECT r.*, s.summary, {PLACES} FROM {run('label', files)} r
            JOIN ({summaries(readable, 'run_id, seq')}) s USING (run_id, seq))
        SELECT run_id, seq, line_no::INTEGER AS line_no, line FROM ({' UNION ALL '.join(rows)})"""


TAKEN = """(SELECT DISTINCT 'src' || doc_id % 20 AS run_id,
    (['en', 'fr', 'de', 'es'])[doc_id % 4 + 1] || ' report' AS stem,
    doc_id // 80 % 7 + 1 AS number FROM labels)"""

FREE_NAMES = f"""WITH wanted AS (
        SELECT run_id, seq, {STEM} AS stem, row_number() OVER (PARTITION BY run_id, {STEM} ORDER BY seq) AS nth
        FROM {NAMES} WHERE name NOT LIKE '%.pdf'),
    numbers AS (SELECT run_id, stem, unnest(generate_series(1, max(nth) + 7)) AS number
        FROM wanted GROUP BY run_id, stem),
    free AS (SELECT run_id, stem, number,
            row_number() OVER (PARTITION BY run_id, stem ORDER BY number) AS nth
        FROM numbers ANTI JOIN {TAKEN} t USING (run_id, stem, number))
    SELECT n.run_id, n.seq, CASE WHEN f.number IS NULL THEN ''
            WHEN f.number = 1 THEN f.stem || '_redacted.md'
            ELSE f.stem || '_redacted_' || f.number || '.md' END AS output
    FROM {NAMES} n LEFT JOIN wanted USING (run_id, seq)
    LEFT JOIN free f ON f.run_id = wanted.run_id AND f.stem = wanted.stem AND f.nth = wanted.nth"""

SAFE = r"""trim(regexp_replace(regexp_replace(name, '[\s/]+', '_', 'g'),
    '[^A-Za-z0-9_.-]', '', 'g'), '._')"""

MANIFEST = f"""SELECT src, seq, {SAFE} AS safe_name FROM (
        SELECT 'pages' AS src, page_id AS seq, url AS name FROM pages
        UNION ALL SELECT 'documents', doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '..'
            WHEN 2 THEN NULL ELSE ' ../' || source || '/My  ' || lang || ' (' || n_chars || ').txt ' END
        FROM documents)
    WHERE name IS NOT NULL AND name <> '' AND {SAFE} <> ''"""

LAST = """SELECT seq, name, last_value(text) OVER (PARTITION BY name ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text
    FROM (SELECT doc_id AS seq, CASE WHEN lang <> 'de' THEN lang || '_' || source END AS name, text
        FROM documents)"""

FIRST = """SELECT name, size, min(seq) AS seq
    FROM (SELECT CASE WHEN role <> 'system' THEN role END AS name,
            CASE WHEN conv_id % 3 <> 0 THEN length(text)::INTEGER END AS size,
            conv_id * 1000 + turn AS seq
        FROM conversations) GROUP BY name, size"""

GATE = f"""SELECT seq, name, {SUFFIX} AS suffix,
        {SUFFIX} IN ({', '.join(map(quoted, ACCEPTED_SUFFIXES))}) AS accepted
    FROM (SELECT seq, name FROM {NAMES} UNION ALL SELECT page_id, url FROM pages)"""

# Submitted listings: usable names, and for each the last content of its name.
LISTED = r"""(SELECT source AS run_id, doc_id AS seq, lang || '_' || doc_id % 40
        || CASE WHEN doc_id % 5 = 0 THEN '.pdf' ELSE '.txt' END AS name, text AS own
    FROM documents WHERE source IS NOT NULL AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)"""
JOB_FILES = f"""(SELECT run_id, seq, name,
        last_value(own) OVER (PARTITION BY run_id, name ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text,
        CASE WHEN name LIKE '%.pdf' THEN 'No extractor for ''.pdf''' END AS error
    FROM {LISTED})"""


def submitted() -> str:
    done = chain(JOB_FILES, "run_id, seq, name, error", list(PATTERNS.values()), "label")
    names = named(JOB_FILES, "error IS NULL")
    return f"""SELECT d.run_id, d.seq, d.name, o.output,
            CASE WHEN d.error IS NULL THEN d.n ELSE 0 END::INTEGER AS n_redacted,
            CASE WHEN d.error IS NULL THEN d.t END AS markdown
        FROM {done} d JOIN {names} o USING (run_id, seq)"""


def outcomes() -> str:
    """run_id, n_ok, n_failed, sentence of the jobs that came to an end."""
    return f"""(SELECT run_id, n_ok, n_failed, CASE
            WHEN n_failed > 0 THEN 'Done — ' || n_ok || ' succeeded, ' || n_failed || ' failed.'
            WHEN n_ok = 1 THEN 'Done — 1 file redacted.'
            ELSE 'Done — ' || n_ok || ' files redacted.' END AS sentence
        FROM (SELECT run_id, count(*) FILTER (error IS NULL) AS n_ok,
            count(*) FILTER (error IS NOT NULL) AS n_failed FROM {JOB_FILES} GROUP BY run_id))"""


NUMBER = "CAST(coalesce(nullif(regexp_extract({}, '([0-9]+)', 1), ''), '0') AS INTEGER)"


def multi_job() -> str:
    """Each source's documents by the options of its number."""
    parts = []
    for k, options in enumerate(w.OPTION_SETS):
        source = f"(SELECT * FROM documents WHERE source IS NOT NULL AND {NUMBER.format('source')} % {len(w.OPTION_SETS)} = {k})"
        patterns = [
            *of(options["labels"]),
            *words(options.get("keywords", ()), options.get("whole_word", False)),
            *options.get("expressions", ()),
        ]
        flags = "c" if options.get("case_sensitive") else "i"
        parts.append(redacted(source, "doc_id", patterns, options["style"], flags))
    return " UNION ALL ".join(f"({part})" for part in parts)


# Words of the texts one by one, and the table of keywords.
WORD = r"[\p{L}\p{N}_]+"
WORDS = f"""keywords AS (SELECT DISTINCT word FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)
        WHERE length(word) >= {w.KEYWORD_LETTERS}),
    parts AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{WORD}') AS gaps,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS hits FROM documents),
    pieces AS (SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit
        FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM parts))"""

def left_totals() -> str:
    """Label, documents and matches of the jobs that are left: old ones gone, every third with longer texts."""
    number = NUMBER.format("run_id")
    files = f"""(SELECT run_id, seq, CASE WHEN {number} % 3 = 0 THEN text || {quoted(w.ADDED)} ELSE text END AS text
        FROM {JOB_FILES} WHERE error IS NULL AND ({number} % 3 = 0 OR {number} <= 6))"""
    return f"""SELECT label, count(*) AS n_docs, sum(n)::BIGINT AS n_matches
        FROM {counts(files, 'run_id, seq')} GROUP BY label"""


STREAM_NAMES = "(SELECT 'stream' AS run_id, doc_id AS seq, lang || '.txt' AS name, text FROM documents)"


def statements() -> dict[str, str]:
    """Name -> SQL."""
    every = list(PATTERNS.values())
    reported = counts(TEXTS, "src, id")
    return {
        "redact_label": redacted("documents", "doc_id", every, "label"),
        "redact_box": redacted("documents", "doc_id", every, "box"),
        "redact_label_dense": redacted(DENSE, "o_orderkey", every, "label"),
        "redact_box_dense": redacted(DENSE, "o_orderkey", every, "box"),
        "redact_all": redacted(TEXTS, "src, id", every, "box"),
        "redaction_spans": spans(TEXTS, "src, id", every),
        "redact_defaults": redacted(DENSE, "o_orderkey", of(DEFAULT_LABELS), "box"),
        "redact_selection": redacted(DENSE, "o_orderkey", of(w.REQUESTED), "label"),
        "redact_order": redacted(DENSE, "o_orderkey", of(w.REORDERED), "label"),
        "redact_order_documents": by_position("documents", "doc_id", of(w.REORDERED)),
        "redact_count": f"""SELECT r.src, r.id, coalesce(d.n, 0)::INTEGER AS n_detected,
                r.n::INTEGER AS n_redacted
            FROM {chain(TEXTS, 'src, id', every, 'box')} r
            LEFT JOIN (SELECT src, id, sum(n) AS n FROM {reported} GROUP BY src, id) d
            USING (src, id)""",
        "redact_nested_marks": redacted(DENSE, "o_orderkey", [*every, "redacted"], "label"),
        "keyword_redact": redacted("documents", "doc_id", words(w.KEYWORDS), "box"),
        "whole_word_redact": redacted("documents", "doc_id", words(w.WHOLE_WORDS, True), "label"),
        "case_sensitive_redact": redacted("documents", "doc_id", words(w.CASED_WORDS), "box", "c"),
        "custom_regex_redact": redacted("documents", "doc_id", w.EXPRESSIONS, "label"),
        "custom_regex_python": redacted("documents", "doc_id", w.PYTHON_EXPRESSIONS, "box"),
        **{
            f"detect_{key}": f"SELECT src, id, {count('text', PATTERNS[label])}::INTEGER AS n"
            f" FROM {TEXTS} WHERE {count('text', PATTERNS[label])} > 0"
            for key, label in w.DETECTOR_KEYS.items()
        },
        "detector_catalog": " UNION ALL ".join(
            f"SELECT {no}::INTEGER AS rule_no, {quoted(label)} AS label, {quoted(p)} AS pattern,"
            f" count(*) FILTER (WHERE {count('text', p)} > 0) AS n_docs,"
            f" sum({count('text', p)})::BIGINT AS n_matches FROM documents"
            for no, (label, p) in enumerate(PATTERNS.items(), start=1)
        ),
        "detect_counts": f"SELECT doc_id, label, n FROM {counts('documents', 'doc_id')}",
        "detect_counts_all": f"SELECT src, id, label, n FROM {reported}",
        "detect_summary": summaries(TEXTS, "src, id"),
        "corpus_detect_totals": f"""SELECT lang, source, rule_no::INTEGER AS rule_no, label,
                count(*) AS n_docs, sum(n)::BIGINT AS n_matches
            FROM {counts('documents', 'lang, source, doc_id')} GROUP BY lang, source, rule_no, label""",
        "source_gate": GATE,
        "scan_text_decode": f"""SELECT src, id, {NEWLINES.format('text')} || chr(10) || 'a' || chr(65533)
                || chr(10) || src AS text FROM {TEXTS}""",
        "scan_text_files": f"""SELECT 'turn ' || conv_id || ' ' || turn || '.MD' AS name,
                {NEWLINES.format('text')} AS text FROM conversations""",
        "extract_html": f"SELECT page_id, {html_text('html')} AS text FROM pages",
        "scan_preview": summaries(
            f"(SELECT run_id, seq, CASE WHEN error IS NULL THEN text ELSE '' END AS text FROM {FILES})",
            "run_id, seq",
        ),
        "input_manifest": MANIFEST,
        "last_write_wins": LAST,
        "dedup_inputs": FIRST,
        "output_names": f"SELECT * FROM {named(NAMES, chr(40) + 'name NOT LIKE ' + quoted('%.pdf') + chr(41))}",
        "output_names_existing": FREE_NAMES,
        "redact_sources": f"SELECT run_id, seq, output, error IS NULL AS ok, n_redacted, markdown FROM {run('label')}",
        "write_outputs": f"SELECT run_id, output, markdown FROM {run('box')} WHERE error IS NULL",
        "bundle_manifest": f"""SELECT output, strlen(markdown)::INTEGER AS size FROM {run('box')}
            WHERE run_id = 'pages' AND output <> ''""",
        "run_results": f"SELECT * FROM {RESULTS}",
        "run_summary": f"""SELECT run_id, n_ok, n_failed, 'Done — ' || n_ok || CASE
                WHEN n_failed > 0 THEN ' succeeded, ' || n_failed || ' failed.'
                WHEN n_ok = 1 THEN ' file redacted.' ELSE ' files redacted.' END AS sentence
            FROM (SELECT run_id, count(*) FILTER (WHERE ok) AS n_ok,
                count(*) FILTER (WHERE NOT ok) AS n_failed FROM {RESULTS} GROUP BY run_id)""",
        "run_progress": f"""SELECT *, floor(current::DOUBLE / total * 100 + 0.5)::INTEGER AS percent
            FROM (SELECT run_id, seq, {PLACES} FROM {FILES})""",
        "activity_log": activity(),
        "expire_runs": """SELECT event_id AS run_id, ts AS created FROM events
            WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
        "run_lookup": f"SELECT * FROM {RESULTS} WHERE run_id = {quoted(w.LOOKUP_RUN)}",
        "export_runs": f"""SELECT run_id, output, markdown AS text FROM {run('label')}
            WHERE error IS NULL""",
        "exported_bundle": f"""SELECT output, strlen(markdown) AS size FROM {run('box')}
            WHERE run_id = {quoted(w.LOOKUP_RUN)} AND error IS NULL""",
        "submit_run": submitted(),
        "run_outcome": f"""SELECT run_id, 'done' AS status, sentence FROM {outcomes()}
            UNION ALL SELECT 'broken', 'error', 'Job failed: [USER_RAISED_EXCEPTION] disk full'""",
        "job_status": f"""SELECT run_id, 'done' AS status, CAST(NULL AS VARCHAR) AS error,
                n_ok + n_failed AS current, n_ok + n_failed AS total, n_ok, n_failed FROM {outcomes()}
            UNION ALL SELECT 'broken', 'error', '[USER_RAISED_EXCEPTION] disk full',
                0, (SELECT count(*) FROM documents), 0, 0""",
        "purge_runs": f"""SELECT run_id, {NUMBER.format('run_id')} > 6 AS removed,
                CASE WHEN {NUMBER.format('run_id')} > 6 THEN 0 ELSE count(*) END AS n_left
            FROM {JOB_FILES} GROUP BY run_id""",
        "live_progress": f"""SELECT run_id, count(*) AS current, count(*) AS total, 100::INTEGER AS percent
            FROM {JOB_FILES} GROUP BY run_id""",
        "log_tail": f"""SELECT number - 1 AS number, line FROM (
                SELECT row_number() OVER (ORDER BY seq, line_no) AS number, line
                FROM ({activity(JOB_FILES)}) WHERE run_id = {quoted(w.LOOKUP_RUN)})
            WHERE number > {w.TAIL_FROM}""",
        "incremental_totals": left_totals(),
        "multi_job_redact": multi_job(),
        "keyword_table_redact": f"""WITH {WORDS} SELECT doc_id,
                string_agg(gap || CASE WHEN word IS NULL THEN coalesce(hit, '') ELSE repeat('{BOX}', length(hit)) END,
                    '' ORDER BY i) AS redacted,
                count(word)::INTEGER AS n_redacted
            FROM pieces LEFT JOIN keywords ON lower(hit) = word GROUP BY doc_id""",
        "keyword_table_totals": f"""WITH {WORDS} SELECT 'Keyword: "' || word || '"' AS label,
                count(DISTINCT doc_id) AS n_docs, count(*) AS n_matches
            FROM pieces JOIN keywords ON lower(hit) = word GROUP BY word""",
        "redact_stream": redacted("documents", "doc_id", every, "label"),
        "redact_stream_named": f"""SELECT seq, o.output, d.n::INTEGER AS n_redacted, d.t AS markdown
            FROM {chain(STREAM_NAMES, 'run_id, seq', every, 'label')} d
            JOIN {named(STREAM_NAMES, 'true')} o USING (run_id, seq)""",
    }
