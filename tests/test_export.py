import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.sources.export import RunFiles, export_runs, exported, exported_bundle, exported_texts


def outputs(spark, tag="", runs=("a", "b c", "ä%2F")):
    rows = [(run, f"{i} ü.md", f"{tag}text {run} {i} 🎈") for run in runs for i in range(20)]
    return spark.createDataFrame([*rows, ("a", "", "failed"), ("a", "none.md", None)], "run_id string, output string, markdown string").repartition(6)


def files_below(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_export_and_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    done = outputs(spark)
    export_runs(done, folder)
    want = {(r.run_id, r.output): r.markdown or "" for r in done.collect() if r.output}
    assert {(r.run_id, r.output): r.size for r in exported(spark, folder).collect()} == {k: len(v.encode()) for k, v in want.items()}
    found = {(r.run_id, r.output): r.text for r in exported_texts(spark, folder).collect()}
    assert {k: v for k, v in found.items() if k[0] != "ä%2F"} == {k: v for k, v in want.items() if k[0] != "ä%2F"}
    assert [r.output for r in exported_bundle(spark, folder, "a").collect()] == sorted(o for r, o in want if r == "a")
    # Another export replaces the runs it has, as a whole, and leaves the others.
    export_runs(outputs(spark, "new ", ("b c",)).filter("output LIKE '1%'"), folder)
    names = {r.output for r in exported_bundle(spark, folder, "b c").collect()}
    assert names == {o for r, o in want if r == "b c" and o.startswith("1")}
    assert (tmp_path / "out/files/b c/1 ü.md").read_text() == "new text b c 1 🎈"
    assert (tmp_path / "out/files/a/1 ü.md").read_text() == "text a 1 🎈"
    assert not list((tmp_path / "out/_drafts").iterdir())


def test_a_job_that_fails_midway_leaves_no_file(spark, tmp_path):
    folder, path = f"file://{tmp_path}/out", tmp_path / "out"
    lost = F.when((F.col("run_id") == "b c") & F.col("output").startswith("7 "), F.raise_error(F.lit("lost"))).otherwise(F.col("markdown"))
    with pytest.raises(Exception, match="lost"):
        export_runs(outputs(spark).withColumn("markdown", lost), folder)
    assert not path.exists() or files_below(path) == []
    export_runs(outputs(spark, "old "), folder)
    before = files_below(path)
    for name in ("../x", "a/b", "."):
        bad = outputs(spark, "new ").unionAll(spark.createDataFrame([("a", name, "x")], "run_id string, output string, markdown string"))
        with pytest.raises(Exception, match="Unsafe output path"):
            export_runs(bad, folder)
    assert files_below(path) == before
    assert all(p.read_text().startswith("old ") for p in (path / "files/b c").iterdir())


def test_nothing_to_export(spark, tmp_path):
    export_runs(outputs(spark).limit(0), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or files_below(tmp_path / "out") == []


def test_texts_are_read_by_the_manifest_alone(spark, tmp_path):
    """No folder of files is listed: what is read are manifests; names that a listing hides or escapes are found."""
    folder = f"file://{tmp_path}/out"
    rows = [("ä%2F", "a b.md", "x\r\ny"), ("r", "_hidden.MD", "h"), ("r", "gone.md", "g"), ("r", "kept.bin", "b"), ("r", "empty.bin", "")]
    export_runs(spark.createDataFrame(rows, "run_id string, output string, markdown string"), folder)
    (tmp_path / "out/files/r/gone.md").unlink()
    (tmp_path / "out/files/r/unlisted.md").write_text("u")
    done = exported_texts(spark, folder)
    assert {(r.run_id, r.output): r.text for r in done.collect()} == {
        ("ä%2F", "a b.md"): "x\ny", ("r", "_hidden.MD"): "h", ("r", "gone.md"): None, ("r", "kept.bin"): None, ("r", "empty.bin"): "",
    }
    assert done.inputFiles() and all("/out/manifest/" in f for f in done.inputFiles())


def test_a_task_that_outlives_the_job_writes_nothing(tmp_path):
    writer = RunFiles({"path": f"file://{tmp_path}/out"}).writer(None, False)
    writer.abort([])
    batch = pa.RecordBatch.from_pydict({"run_id": ["r"], "output": ["a.md"], "markdown": ["text"]})
    with pytest.raises(OSError):
        writer.write(iter([batch]))
    assert files_below(tmp_path) == []
