"""Corpora written as files: what tasks write themselves is what Spark's writer makes, and documents are opened once."""

import os

from strandline.sources import corpus as C


def tree(folder):
    return {(os.path.relpath(at, folder), open(f"{at}/{f}").read()) for at, _, files in os.walk(folder) for f in files if f.startswith("part-")}


def test_documents_lie_as_sparks_writer_has_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "x\ny"), (2, "c/d%=:e", ""), (3, "ä", None), (4, "q", "ü" * 3)], "video_id long, artifact string, value string")
    rows.write.partitionBy("video_id", "artifact").text(f"{tmp_path}/theirs")
    for _ in range(2):  # written again, nothing changes
        C.write_documents(rows, ["video_id", "artifact"], f"file://{tmp_path}/ours")
        assert tree(tmp_path / "ours") == tree(tmp_path / "theirs")
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "ours")) == 4  # no checksums, nothing staged
    listing = C.list_files(spark, f"{tmp_path}/ours", "part-*", r"/video_id=([^/]+)/", r"/artifact=([^/]+)/")
    assert {(r.video_id, r.n_bytes) for r in listing.collect()} == {("1", 4), ("2", 1), ("3", 1), ("4", 7)}


def test_tolerant_read_opens_documents_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": ['), (3, '{"a": ['), (5, "{}")], "video_id long, value string")
    C.write_documents(rows, ["video_id"], str(tmp_path / "c"))
    read = C.read_artifact(spark, str(tmp_path / "c"), "a int", r"/video_id=([^/]+)/")
    expected = spark.createDataFrame([("1",), ("2",), ("4",), ("4",), (None,)], "video_id string")
    good, issues = C.tolerant(read, expected, "shots")
    assert issues._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert sorted((r.video_id, r.a) for r in good.collect()) == [("1", 1), ("5", None)]
    assert sorted((str(r.video_id), r.severity, r.artifact, r.message) for r in issues.collect()) == [
        ("2", "error", "shots", "corrupt"), ("3", "error", "shots", "corrupt"), ("4", "warning", "shots", "missing"), ("4", "warning", "shots", "missing"), ("None", "warning", "shots", "missing")]
