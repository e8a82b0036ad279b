"""The rule compiler: what groups of facts tell, how often, and how often artifacts are read."""

from strandline.operators import quality as Q
from strandline.operators import rules as R
from strandline.plans import quality as plans


def told(*parts):
    return sorted((r.path, r.message, r.expected, r.actual) for r in R.judge(*parts).collect())


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_uses_need_a_definition_and_are_told_as_often_as_they_occur(spark):
    used = R.facts(rows(spark, [(1, "a"), (1, "a"), (2, "b"), (3, None)], "i int, k string"), R.use("d", R.ident("k"), "undefined", artifact="x", path="i", message="unknown", actual="k"))
    defined = R.facts(rows(spark, [("b",), ("b",), ("c",)], "k string"), R.define("d", R.ident("k"), "unused", artifact="x", path="k", message="unused"))
    assert told(used, defined) == [("1", "unknown", None, "a"), ("1", "unknown", None, "a"), ("c", "unused", None, None)]


def test_keys_of_two_columns_do_not_run_together(spark):
    used = R.facts(rows(spark, [("a/b", "c")], "k string, l string"), R.use("d", R.ident("k", "l"), "undefined", artifact="x", path="k", message="unknown"))
    defined = R.facts(rows(spark, [("a", "b/c")], "k string, l string"), R.define("d", R.ident("k", "l")))
    assert told(used, defined) == [("a/b", "unknown", None, None)]


def test_counts_sums_and_bounds(spark):
    many = R.facts(rows(spark, [(1, 5), (1, 9), (1, 7), (2, 1)], "v int, t int"), R.use("n", R.ident("v"), "undeclared", artifact="x", path="v", message="count"), R.use("b", R.ident("v"), low="t", high="t"))
    said = R.facts(rows(spark, [(1, 4, 5), (3, 1, 0)], "v int, n int, a int"), R.define("n", R.ident("v"), "count", said="n", artifact="x", path="v", message="count"), R.define("b", R.ident("v"), "to", said="a", artifact="x", path="v", message="end"))
    assert told(many, said) == [("1", "count", "3", "4"), ("1", "end", "5", "9"), ("2", "count", "1", "0"), ("3", "count", "0", "1")]


def test_an_issue_of_several_parts_needs_all(spark):
    own = {"artifact": "x", "path": "i", "message": "both", "parts": "2"}
    used = R.facts(rows(spark, [(1, "a", "p"), (2, "a", "q"), (3, "b", "p")], "i int, k string, l string"), R.use("k", R.ident("k"), "defined", **own), R.use("l", R.ident("l"), "undefined", **own))
    known = R.facts(rows(spark, [("a", "q")], "k string, l string"), R.define("k", R.ident("k")), R.define("l", R.ident("l")))
    assert told(used, known) == [("1", "both", None, None)]


def test_words_are_quoted(spark):
    df = rows(spark, [("it's",), ("a\\d",), ("7",)], "c string")
    found = Q.schema_rules(df, "it's", R_path(), {"c": {"enum": ["it's", "a\\d"], "pattern": "^[^0-9]+$"}}).collect()
    assert sorted((r.artifact, r.message, r.actual) for r in found) == [("it's", "c: enum", "7"), ("it's", "c: pattern", "7")]


def R_path():
    from pyspark.sql import functions as F

    return F.col("c")


def test_empty_tables_break_no_rule(spark):
    nothing = rows(spark, [], "video long, state string, id long, ratio double")
    assert Q.music_rules(nothing, rows(spark, [], "video long, state string, n long")).count() == 0


def test_each_artifact_is_read_once(spark):
    sf = "/root/testdata/sf0.001"
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    for name, artifacts in {"shots_internal": 4, "story_rules": 6, "timeline_rules": 4, "relation_rules": 3}.items():
        assert scans(plans.QUERIES[name][0](spark, sf)) <= artifacts, name
    assert scans(plans.issue_gate(spark, sf)) < 80
