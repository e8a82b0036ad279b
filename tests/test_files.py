"""File listings of a corpus: names, sizes and pruning, without reading a file; frames against the files that exist."""

from pyspark.sql import functions as F

from strandline.operators import quality as Q
from strandline.sources import corpus as C


def corpus(tmp_path):
    for video, names in {"v1": {"shots": "{}", "asr": "{}"}, "v2": {"shots": "\n", "media": ""}, "v 3": {"extra": "{}"}}.items():
        raw = tmp_path / video / "raw"
        (raw / "frames").mkdir(parents=True)
        for name, text in names.items():
            (raw / f"{name}.json").write_text(text)
        (raw / "frames" / "0001.jpg").write_bytes(b"x" * 10)
    return str(tmp_path)


def test_listing(spark, tmp_path):
    path = corpus(tmp_path)
    found = C.list_files(spark, path)
    assert {(r.video_id, r.artifact, r.file.replace("%20", " "), r.n_bytes) for r in found.collect()} >= {("v1", "shots", "v1/raw/shots.json", 2), ("v1", "asr", "v1/raw/asr.json", 2), ("v2", "shots", "v2/raw/shots.json", 1)}
    assert found.count() == 4  # not the one without a byte
    assert C.list_files(spark, path, "shots.json").count() == 2 and C.list_files(spark, path, videos=["v1"]).count() == 2
    plan = found.where("n_bytes > 1")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "GreaterThan(length,1)" in plan
    assert found.where("n_bytes > 1").count() == 3


def test_issues(spark, tmp_path):
    expected = spark.createDataFrame([("v1", "shots"), ("v1", "shots"), ("v1", "asr"), ("v2", "shots"), ("v2", "asr"), ("v9", "shots")], "video_id string, artifact string")
    found = C.list_files(spark, corpus(tmp_path)).where("video_id like 'v_'")
    assert {tuple(r) for r in C.file_issues(expected, found).collect()} == {("v2", "shots", "empty"), ("v2", "asr", "missing"), ("v9", "shots", "missing")}
    assert {r.issue for r in C.file_issues(expected.limit(0), found).collect()} == {"unexpected"} and C.file_issues(expected, found.limit(0)).where("issue <> 'missing'").count() == 0


def test_frames_against_real_files(spark, tmp_path):
    """The rule of frames whose file does not exist takes a listing as it is."""
    files = C.list_files(spark, corpus(tmp_path), "*.jpg", r"/([^/]+)/raw/")
    frames = spark.createDataFrame([("v1", 1, 1, 5, 1, "v1/raw/frames/0001.jpg"), ("v1", 2, 2, 6, 1, "v1/raw/frames/0002.jpg")], "video string, i int, id int, t long, shot int, file string")
    shots = spark.createDataFrame([("v1", 1)], "video string, shot int")
    ranges = spark.createDataFrame([("v1", 0, 10)], "video string, range_start long, range_end long")
    got = Q.frame_rules(frames, shots, ranges, files.select("file")).collect()
    assert [(r.message, r.actual) for r in got] == [("no such file", "v1/raw/frames/0002.jpg")]
    assert Q.frame_rules(frames, shots, ranges, files.where(F.lit(False)).select("file")).count() == 2
