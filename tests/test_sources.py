import os

import pytest
from pyspark.sql import functions as F

from inkveil.functions.names import accepted, safe_name, stem, suffix
from inkveil.functions.rules import build_rules, detector_rules
from inkveil.operators.manifest import (
    NO_FILES,
    input_manifest,
    number_inputs,
    require_inputs,
)
from inkveil.plans.run import preview_sources, redact_sources, store_run
from inkveil.sources.extract import extract, html_to_markdown
from inkveil.sources.files import decode_text, read_files, scan_text_files
from inkveil.sources.outputs import bundle_manifest, export_files, read_outputs, write_outputs

EIN = "Employer Identification Numbers (EINs)"


def test_decoding_equals_python(spark):
    samples = [b"", b"a\r\nb\rc\n\r\n\r\r", "﻿é😀".encode(), b"\xff\xfe", b"\xc3", b"\xc3(", b"\xe2\x82",
               b"\xf0\x9f\x98", b"\xf0\x9f\x98x", b"\xed\xa0\x80", b"\xc0\x80", b"\xf8\x88\x80\x80\x80", b"\xe2\x28\xa1"]
    samples += [os.urandom(40) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(s),) for s in samples], "content binary")
    for row in df.select("content", decode_text(F.col("content")).alias("t")).collect():
        text = bytes(row.content).decode("utf-8", errors="replace")
        assert row.t == text.replace("\r\n", "\n").replace("\r", "\n")


def test_names(spark):
    from pathlib import PurePosixPath

    names = ["a.txt", ".bashrc", "a.tar.gz", "name.", "..a", "...", "a..b", ".a.b", "A.PDF", "none", "x.\n"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    name = F.col("name")
    for r in df.select("name", stem(name).alias("s"), suffix(name).alias("x"), accepted(name).alias("ok")).collect():
        path = PurePosixPath(r.name)
        assert (r.s, r.x) == (path.stem, path.suffix.lower()), r.name
        assert r.ok == (r.name in ("a.txt", "A.PDF"))


def test_safe_names(spark):
    cases = {
        "My cool movie.mov": "My_cool_movie.mov",
        "../../../etc/passwd": "etc_passwd",
        "i contain cool ümläuts.txt": "i_contain_cool_umlauts.txt",
        " ?_a b.txt. ": "a_b.txt",
        "a\t\x0b\x1c b": "a_b",
        "back\\slash": "backslash",
        "..": "",
        "日本": "",
        "ﬁne½.md": "fine12.md",
    }
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    got = {r.name: r.s for r in df.select("name", safe_name(F.col("name")).alias("s")).collect()}
    assert got == cases


def test_manifest_drops_and_refuses(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, ".."), (4, "a b")], "seq int, name string")
    assert [(r.seq, r.safe_name) for r in input_manifest(df).collect()] == [(4, "a_b")]
    with pytest.raises(ValueError, match=NO_FILES):
        require_inputs(df.filter("seq > 9"))


def test_numbering_follows_order(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(200)], "path string").repartition(7)
    rows = number_inputs(df, "path").collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.seq)] == [f"{i:03d}" for i in range(200)]


def test_text_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a b.TXT").write_bytes(b"x\r\ny\xff")
    (tmp_path / "sub dir" / "c.md").write_bytes("﻿é".encode())
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    rows = {r["name"]: r.text for r in scan_text_files(spark, str(tmp_path)).collect()}
    assert rows == {"a b.TXT": "x\ny�", "c.md": "﻿é"}
    sizes = {r["name"]: r["size"] for r in read_files(spark, str(tmp_path)).collect()}
    assert sizes == {"a b.TXT": 5, "c.md": 5, "d.pdf": 4}


def test_html(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
      <!-- a <b> --><script>var t="</p>";</script><H1 class="x">Head &amp; more</H1>
      <p>One <b>two</b>&nbsp;three<br>four &lt;x&gt; 1 < 2</p><ul><li>a</li><li>b</li></ul></body></html>"""
    df = spark.createDataFrame([(html,)], "html string")
    text = df.select(html_to_markdown(F.col("html")).alias("t")).first().t
    assert text == "# Head & more\n\nOne two three\nfour <x> 1 < 2\n\n- a\n- b"


def markdown(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(html_to_markdown(F.col("html")).alias("t")).first().t


def test_character_references(spark):
    assert markdown(spark, "<p>john&#64;example.com 555&#45;010&#x2D;1234</p>") == "john@example.com 555-010-1234"
    assert markdown(spark, "&#x1F600;&#233;&eacute;&euro;&#38;lt; &amp;amp; &amp;#64;") == "😀éé€&lt; &amp; &#64;"
    assert markdown(spark, "a & b &unknown; &#; &#xZZ; &lt") == "a & b &unknown; &#; &#xZZ; &lt"
    assert markdown(spark, "&#0;&#xD800;&#1114112;&#64") == "\ufffd\ufffd\ufffd@"
    rules = detector_rules()
    page = [("r", 1, "a.html", bytearray(b"<p>john&#64;example.com</p>"))]
    df = spark.createDataFrame(page, "run_id string, seq bigint, name string, content binary")
    assert redact_sources(df, rules, "label").first().markdown == "[REDACTED]"


def test_all_named_and_padded_references(spark):
    assert markdown(spark, "&commat;&period;&lowbar;&plus;&lpar;&CounterClockwiseContourIntegral;") == "@._+(\u2233"
    assert markdown(spark, "&#0000000064;&#x000000040;a&NonBreakingSpace;b &nosuchname;") == "@@a b &nosuchname;"
    page = [("r", 1, "a.html", bytearray(b"<p>john&commat;example&period;com</p><p>jo&#0000000064;example.com</p>"))]
    df = spark.createDataFrame(page, "run_id string, seq bigint, name string, content binary")
    done = redact_sources(df, detector_rules(), "label").first()
    assert done.markdown == "[REDACTED]\n\n[REDACTED]" and done.n_redacted == 2


@pytest.mark.parametrize("piece", ["<!--", "<h1 ", "<script ", "<style>", "&#", "&amp", "<"])
def test_malformed_pages_take_linear_time(spark, piece):
    import time

    page = piece * (1_000_000 // len(piece))
    markdown(spark, piece)  # compiled
    start = time.perf_counter()
    markdown(spark, page)
    assert time.perf_counter() - start < 4


def test_unclosed_parts_run_to_the_end(spark):
    assert markdown(spark, "<p>a</p><!-- b <p>c</p>") == "a"
    assert markdown(spark, "a<script>b</scripty>c") == "a"
    assert markdown(spark, '<a href="mailto:x@y.com">write</a>') == "write"


def broken(content):
    raise RuntimeError("bad file")


FILES = [
    ("r", 1, "tax-form.pdf", b"placeholder"),
    ("r", 2, "tax-form.bad", b"x"),
    ("r", 3, "tax-form.txt", b"EIN: 12-3456789"),
    ("r", 4, "tax-form.xyz", b"x"),
    ("r", 5, "page.html", b"<p>mail a@b.co</p>"),
    ("r", 6, "tax-form.csv", b"12-3456789"),
    ("s", 1, "tax-form.md", b"nothing"),
    ("s", 2, "scan.png", b"bad"),
]
EXTRACTORS = {
    ".pdf": lambda content: "# Tax form\n\nEIN: 12-3456789\n",
    ".bad": broken,
    ".png": broken,
    ".csv": lambda content: content.decode(),
}


def files(spark):
    rows = [(a, b, c, bytearray(d)) for a, b, c, d in FILES]
    return spark.createDataFrame(rows, "run_id string, seq bigint, name string, content binary")


def test_extractors_and_failures(spark):
    rows = {(r.run_id, r.seq): (r.text, r.error) for r in extract(files(spark), EXTRACTORS).collect()}
    assert rows["r", 1] == ("# Tax form\n\nEIN: 12-3456789\n", None)
    assert rows["r", 2] == (None, "bad file")
    assert rows["r", 4] == (None, "No extractor for '.xyz'")
    assert rows["r", 5] == ("mail a@b.co", None)
    assert extract(files(spark)).filter("error IS NULL").count() == 3


def test_preview_is_gated(spark):
    rows = preview_sources(files(spark), detector_rules(), EXTRACTORS).collect()
    found = {(r.run_id, r.seq): {m.label: m.n for m in r.matches} for r in rows}
    assert found["r", 1] == found["r", 3] == {EIN: 1}
    assert found["r", 6] == found["r", 2] == {}
    assert {(r.run_id, r.seq): r.error for r in rows}["r", 6] is None


def test_a_whole_run(spark, tmp_path):
    rules = build_rules([EIN, "Email addresses"])
    done = redact_sources(files(spark), rules, "label", EXTRACTORS)
    tables = store_run(done, str(tmp_path / "run"))
    rows = {(r.run_id, r.seq): r for r in tables.documents.collect()}
    assert rows["r", 1].markdown == "# Tax form\n\nEIN: [REDACTED]\n"
    outputs = {k: r.output for k, r in rows.items()}
    assert outputs == {
        ("r", 1): "tax-form_redacted.md", ("r", 2): "", ("r", 3): "tax-form_redacted_2.md",
        ("r", 4): "", ("r", 5): "page_redacted.md", ("r", 6): "tax-form_redacted_3.md",
        ("s", 1): "tax-form_redacted.md", ("s", 2): "",
    }
    summary = {r.run_id: (r.n_ok, r.n_failed, r.sentence) for r in tables.summary.collect()}
    assert summary == {
        "r": (4, 2, "Done — 4 succeeded, 2 failed."),
        "s": (1, 1, "Done — 1 succeeded, 1 failed."),
    }
    log = [r.line for r in tables.activity.filter("run_id = 'r'").orderBy("seq", "line_no").collect()]
    assert log[:5] == [
        "[1/6] Scanning tax-form.pdf...",
        f"  Detected -> {EIN}: 1",
        "  Redacting tax-form.pdf...",
        "  MARKDOWN: 1 match(es) redacted.",
        "  Saved -> tax-form_redacted.md",
    ]
    assert log[5:10] == [
        "[2/6] Scanning tax-form.bad...",
        "  No matches in preview (Markdown export still runs).",
        "  Redacting tax-form.bad...",
        "  ERROR redacting tax-form.bad: bad file",
        "  FAILED: bad file",
    ]
    png = tables.activity.filter("run_id = 's' AND seq = 2").orderBy("line_no").collect()
    assert [r.line for r in png][1] == "  (preview failed for scan.png: bad file)"
    percents = [r.percent for r in tables.progress.filter("run_id = 'r'").orderBy("current").collect()]
    assert percents == [17, 33, 50, 67, 83, 100]


def test_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    done = redact_sources(files(spark), detector_rules(), "label", EXTRACTORS)
    write_outputs(done.filter("error IS NULL"), path)
    write_outputs(done.filter("error IS NULL AND run_id = 's'"), path)
    stored = read_outputs(spark, path)
    assert stored.count() == 5
    listing = bundle_manifest(stored, "r").collect()
    assert [r.output for r in listing] == [
        "page_redacted.md", "tax-form_redacted.md", "tax-form_redacted_2.md", "tax-form_redacted_3.md",
    ]
    assert listing[0].size == len("mail [REDACTED]")
    folder = tmp_path / "files"
    exported = export_files(stored, f"file://{folder}").collect()
    found = {(run, name) for run in os.listdir(folder) for name in os.listdir(folder / run)}
    assert {(r.run_id, r.output) for r in exported} == found and len(found) == 5
    assert (folder / "r" / "tax-form_redacted_2.md").read_text() == "EIN: [REDACTED]"
    assert (folder / "s" / "tax-form_redacted.md").read_text() == "nothing"
    assert (folder / "r" / "tax-form_redacted.md").read_text() != "nothing"


@pytest.mark.parametrize("run_id,output", [("r", "../up.md"), ("..", "a.md"), ("r", "a/b.md"), ("", "a.md")])
def test_unsafe_outputs_are_refused(spark, tmp_path, run_id, output):
    df = spark.createDataFrame([(run_id, output, "x")], "run_id string, output string, markdown string")
    with pytest.raises(Exception, match="Unsafe output path"):
        export_files(df, f"file://{tmp_path}/files").collect()
    assert not (tmp_path / "up.md").exists()


def test_stored_runs_are_few_files_and_prune(spark, tmp_path):
    rows = [(f"r{i % 6}" if i % 3 else "hot", i, f"o{i}.md", "x") for i in range(600)]
    df = spark.createDataFrame(rows, "run_id string, seq int, output string, markdown string").repartition(16)
    path = tmp_path / "out"
    write_outputs(df, str(path), rows_per_file=100)
    files = {d: len(list((path / d).glob("*.parquet"))) for d in os.listdir(path) if d.startswith("run_id")}
    assert all(n == 1 for d, n in files.items() if "hot" not in d) and 1 < files["run_id=hot"] <= 3
    plan = read_outputs(spark, str(path)).filter("run_id = 'r1'")
    assert plan.count() == sum(r[0] == "r1" for r in rows)
    assert "PartitionFilters: [isnotnull(run_id" in plan._jdf.queryExecution().executedPlan().toString()
