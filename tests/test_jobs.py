import pytest

from inkveil.functions.rules import build_rules
from inkveil.operators.ledger import UNKNOWN_RUN, expire_runs, require_run
from inkveil.operators.manifest import NO_FILES, NO_VALID_FILES
from inkveil.plans import jobs
from inkveil.plans.jobs import job_documents, job_runs, job_status, latest_progress, live_progress, log_tail, submit
from inkveil.plans.scratch import Staging, scratch_path

RULES = build_rules(["Email addresses"])
LISTING = "seq bigint, name string, content binary"


def listing(spark, *rows):
    return spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in rows], LISTING)


def test_a_submitted_job(spark):
    root = scratch_path(spark, "jobs")
    files = listing(
        spark, (1, "../a b.txt", b"x@y.co"), (2, "", b"skipped"), (3, "a b.txt", b"last z@y.co"),
        (4, "..", b"unusable"), (5, "c.pdf", b"%PDF"), (6, None, b"skipped"), (7, "a/b.txt", b"other"),
    )
    run = submit(files, RULES, root, style="label")
    rows = {r.seq: r for r in job_documents(spark, root).documents.collect()}
    assert {k: (r.name, r.output) for k, r in rows.items()} == {
        1: ("a_b.txt", "a_b_redacted.md"), 3: ("a_b.txt", "a_b_redacted_2.md"),
        5: ("c.pdf", ""), 7: ("a_b.txt", "a_b_redacted_3.md"),
    }
    assert {rows[k].markdown for k in (1, 3, 7)} == {"other"}
    (status,) = job_status(spark, root, run).collect()
    assert (status.status, status.error, status.current, status.total) == ("done", None, 4, 4)
    assert status.sentence == "Done — 3 succeeded, 1 failed."
    other = submit(listing(spark, (1, "d.txt", b"q@r.st")), RULES, root)
    assert {r.run_id for r in job_status(spark, root).collect()} == {run, other}
    assert job_documents(spark, root).documents.filter("markdown = '██████'").count() == 1


def test_refused_listings_leave_no_run(spark):
    root = scratch_path(spark, "jobs")
    with pytest.raises(ValueError, match=NO_FILES):
        submit(listing(spark, (1, "", b"x")), RULES, root)
    with pytest.raises(ValueError, match=NO_VALID_FILES):
        submit(listing(spark, (1, "..", b"x")), RULES, root)
    submit(listing(spark, (1, "a.txt", b"x")), RULES, root, "only")
    assert [r.run_id for r in job_runs(spark, root).collect()] == ["only"]


def test_a_job_that_breaks_off(spark):
    root = scratch_path(spark, "jobs")
    good = listing(spark, (1, "a.txt", b"x"))
    submit(good, RULES, root, "good")
    submit(good.selectExpr("seq", "name", "cast(raise_error('disk full') AS binary) AS content"), RULES, root, "bad")
    runs = {r.run_id: r for r in job_runs(spark, root).collect()}
    assert runs["good"].status == "done" and runs["bad"].status == "error" and "disk full" in runs["bad"].error
    (status,) = job_status(spark, root, "bad").collect()
    assert status.sentence.startswith("Job failed: ") and (status.current, status.n_ok) == (0, 0)
    assert job_status(spark, root, "none").count() == 0
    with pytest.raises(LookupError, match=UNKNOWN_RUN):
        require_run(job_runs(spark, root), "none")
    newest = max(r.created for r in runs.values())
    assert expire_runs(job_runs(spark, root), newest).count() == 2


def test_nothing_is_left_of_a_job_but_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("inkveil.plans.scratch.ensure_checkpoint_dir", lambda _: f"file://{tmp_path}/scratch")
    root = f"{tmp_path}/jobs"
    submit(listing(spark, (1, "a.pdf", b"x")), RULES, root, "r", extractors={".pdf": lambda c: "a@b.co"})
    assert list((tmp_path / "scratch").iterdir()) == []
    assert sorted(p.name for p in (tmp_path / "jobs").iterdir()) == ["documents", "runs"]


def test_staging_is_cleared(spark):
    staging = Staging(spark)
    assert staging.store(spark.range(3), "few").count() == 3
    path = staging.paths[0].removeprefix("file://")
    staging.clear()
    import os

    assert not os.path.exists(path) and staging.paths == []


def test_progress_and_log_of_a_job_that_is_half_done(spark, tmp_path, monkeypatch):
    root, lines, checkpoint = f"{tmp_path}/jobs", f"{tmp_path}/lines", f"{tmp_path}/checkpoint"
    names = [f"{'ab'[i % 2]}.{'pdf' if i % 5 == 4 else 'txt'}" for i in range(12)]
    files = listing(spark, *[(10 * i, name, f"x{i}@b.co".encode()) for i, name in enumerate(names)])
    seen, logs, read = [], [], 0
    whole = jobs.store_run

    def stored(*args, **options):
        nonlocal read
        whole(*args, **options)
        (status,) = job_status(spark, root, "r").collect()
        live_progress(spark, root, lines, checkpoint).awaitTermination()
        (live,) = latest_progress(spark, lines).collect()
        seen.append((status.status, status.current, status.total, status.sentence, live.current, live.total, live.percent))
        new = [tuple(r) for r in log_tail(spark, root, "r", read).orderBy("number").collect()]
        assert [n for n, _ in new] == list(range(read, read + len(new)))
        logs.extend(line for _, line in new)
        read += len(new)

    monkeypatch.setattr(jobs, "store_run", stored)
    submit(files, RULES, root, "r", "label", slices=3)
    assert seen == [("running", 4 * i, 12, None, 4 * i, 12, round(100 * i / 3)) for i in (1, 2, 3)]
    monkeypatch.undo()
    submit(files, RULES, root, "one", "label")
    log = [r["line"] for r in log_tail(spark, root, "one").orderBy("number").collect()]
    assert logs == log and log[0].startswith("[1/12] ")
    both = job_documents(spark, root).documents.drop("run_id")
    assert both.distinct().count() == 12 and both.count() == 24
    (status,) = job_status(spark, root, "r").collect()
    assert (status.status, status.current, status.total, status.n_failed) == ("done", 12, 12, 2)


def test_totals_follow_the_runs(spark, tmp_path):
    import re
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from inkveil.plans.jobs import purge_runs, submit_all
    from inkveil.plans.totals import incremental_totals, update_totals

    root, path = f"file://{tmp_path}/jobs", f"file://{tmp_path}/totals"
    now = datetime(2024, 5, 1, 12)

    def put(runs, text, age=0):
        rows = [(run, i, f"{i}.txt", bytearray(text.encode())) for run in runs for i in range(4)]
        files = spark.createDataFrame(rows, "run_id string, seq bigint, name string, content binary")
        made = [(run, ["Email addresses", "URLs"], "label", now - timedelta(seconds=age)) for run in runs]
        jobs = spark.createDataFrame(made, "run_id string, labels array<string>, style string, created timestamp")
        assert submit_all(files, jobs, root).count() == 0

    def whole():
        found = job_documents(spark, root).documents.select(F.inline("matches")).groupBy("label")
        return sorted(map(tuple, found.agg(F.count("*"), F.sum("n")).collect()))

    def step():
        read = {r["run_id"] for r in update_totals(spark, root, path).collect()}
        assert sorted(map(tuple, incremental_totals(spark, path).collect())) == whole()
        return read

    put("abc", "x@y.co http://z.co/ x@y.co", 9999)
    put("d", "nothing")
    assert step() == set("abcd") and step() == set()
    put("b", "http://z.co/ only")
    put("e", "q@r.st")
    assert step() == set("be")
    assert {r["run_id"] for r in purge_runs(spark, root, now).filter("removed").collect()} == set("ac")
    assert step() == set() and [r[0] for r in whole()] == ["Email addresses", "URLs"]
    put("b", "clean again")
    assert step() == {"b"} and whole() == [("Email addresses", 4, 4)]
    put("a", "back a@b.co")
    assert step() == {"a"} and whole() == [("Email addresses", 8, 8)]
    assert len({re.search("batch=([0-9]+)", str(p))[1] for p in (tmp_path / "totals").glob("batch=*")}) == 5  # one update had nothing to add
