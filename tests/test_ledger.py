import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkveil.operators import ledger
from inkveil.plans.scratch import scratch_path
from inkveil.functions.rules import detector_rules
from inkveil.operators.redact import redact
from inkveil.sources.files import decode_text
from inkveil.streaming.redact_stream import (
    named_outputs,
    redact_stream,
    start_named,
    start_table,
    stream_files,
)

NOW = datetime(2024, 5, 1, 12)


def runs(spark):
    rows = [
        ("a", NOW - timedelta(seconds=3600), "done", None),
        ("b", NOW - timedelta(seconds=3600, microseconds=1), "done", None),
        ("c", NOW, "error", None),
        ("d", NOW, "error", "disk full"),
        ("e", NOW, "running", None),
        ("f", NOW, "done", None),
    ]
    return spark.createDataFrame(rows, "run_id string, created timestamp, status string, error string")


def test_expiry_at_the_cutoff(spark):
    alive = ledger.expire_runs(runs(spark), NOW)
    assert sorted(r.run_id for r in alive.collect()) == ["a", "c", "d", "e", "f"]


def test_outcome(spark):
    results = spark.createDataFrame(
        [("a", 1, True), ("a", 2, False), ("f", 1, True)], "run_id string, seq int, ok boolean"
    )
    said = {r.run_id: r.sentence for r in ledger.run_outcome(runs(spark), results).collect()}
    assert said == {
        "a": "Done — 1 succeeded, 1 failed.",
        "b": "Done — 0 files redacted.",
        "c": "Job failed: unknown error",
        "d": "Job failed: disk full",
        "e": None,
        "f": "Done — 1 file redacted.",
    }


def test_lookup(spark):
    assert ledger.require_run(runs(spark), "d").first().error == "disk full"
    with pytest.raises(LookupError, match=ledger.UNKNOWN_RUN):
        ledger.require_run(runs(spark), "zz")


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("mail a@b.co")
    (folder / "b.txt").write_text("nothing")
    stream = stream_files(spark, str(folder)).select("name", decode_text(F.col("content")).alias("text"))
    done = redact_stream(stream, detector_rules())
    out, progress = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    start_table(done, out, progress).awaitTermination()
    (folder / "c.txt").write_text("c@d.eu")
    start_table(done, out, progress).awaitTermination()
    rows = spark.read.schema(done.schema).parquet(out)
    batch = redact(rows.select("name", "text"), detector_rules())
    assert sorted(rows.select(batch.columns).collect()) == sorted(batch.collect())
    assert rows.count() == 3
    with pytest.raises(ValueError):
        redact_stream(rows, detector_rules())


def test_names_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, progress = scratch_path(spark, "named"), scratch_path(spark, "progress")
    for n, name in enumerate(["a.txt", "a.md", "b.txt", "a.html"]):
        (folder / name).write_text(f"x{n}@b.co")
        stream = stream_files(spark, str(folder)).selectExpr("cast(1 as bigint) AS seq", "name", "content")
        start_named(stream, detector_rules(), out, progress, "label").awaitTermination()
    rows = named_outputs(spark, out).orderBy("batch_id").collect()
    assert [r.output for r in rows] == [
        "a_redacted.md", "a_redacted_2.md", "b_redacted.md", "a_redacted_3.md",
    ]
    assert {r.markdown for r in rows} == {"[REDACTED]"}
    # Numbers alone are kept beside the texts.
    assert spark.read.parquet(f"{out}_names").drop("batch_id").columns == ["seq", "name", "number"]


def test_names_of_many_batches_come_from_the_state(spark, tmp_path, monkeypatch):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "p")
    folder.mkdir()
    rng, listed, plans = random.Random(2), [], []
    for batch in range(10):
        for i in range(6):
            name = f"{rng.choice('abcdef')}.{rng.choice(['txt', 'md', 'pdf'])}"
            (folder / f"{batch}-{i}").mkdir()
            (folder / f"{batch}-{i}" / name).write_text("x@b.co")
            listed.append((batch * 6 + i, name))
        stream = stream_files(spark, str(folder))
        seq = F.split(F.element_at(F.split("path", "/"), -2), "-")
        stream = stream.select((seq[0].cast("bigint") * 6 + seq[1].cast("bigint")).alias("seq"), "name", "content")
        done = start_named(stream, detector_rules(), out, progress, "label")
        done.awaitTermination()
        state = done.names.lastProgress["stateOperators"][0]
        plans.append((state["numRowsTotal"], done.names.lastProgress["numInputRows"]))
    counts, want = {}, {}
    for seq, name in listed:
        stem, kind = name.split(".")
        counts[stem] = counts.get(stem, 0) + (kind != "pdf")
        n = counts[stem]
        want[seq] = "" if kind == "pdf" else f"{stem}_redacted{'' if n == 1 else f'_{n}'}.md"
    assert {r["seq"]: r["output"] for r in named_outputs(spark, out).collect()} == want
    # A batch reads its own files, and the state has a row per stem, not per name.
    assert all(n <= 6 for n, _ in plans) and len({rows for _, rows in plans}) == 1
