"""Exact percentiles: equal to sorting, for hot keys, repeated and neighbouring values, nulls and infinities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import aggregate as A
from strandline.operators.quantiles import _of_hot, exact_percentiles

SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


def by_sorting(values):
    values = sorted(v for v in values if v is not None)
    out = []
    for p in SHARES:
        at = p * (len(values) - 1)
        i, j = math.floor(at), math.ceil(at)
        out.append(values[i] if values[i] == values[j] else (j - at) * values[i] + (at - i) * values[j])
    return out


def groups():
    rnd = random.Random(3)
    return {
        "hot": [rnd.gauss(0, 1) for _ in range(6000)], "ties": [float(rnd.choice([1, 1, 1, 2, 9])) for _ in range(3000)], "one": [7.0] * 2500, None: [rnd.random() * 10**12 for _ in range(2500)] + [None] * 40,
        "close": [math.nextafter(1.5, 2) if i % 3 else 1.5 + i % 2 * 2**-40 for i in range(1500)], "small": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-320, -290) for _ in range(1501)] + [0.0],
        "few": [3.0, None, 1.0, 2.5], "far": [rnd.random() for _ in range(2500)] + [1e300, -1e300, math.inf], "none": [None, None],
    }


@pytest.mark.parametrize("hot_rows", [0, 1000, 10**6])
def test_percentiles(spark, hot_rows):
    data = groups()
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: r.p for r in exact_percentiles(df, "v", SHARES, ["g"], "p", hot_rows).collect()}
    assert got.pop("none") is None
    data.pop("none")
    assert set(got) == set(data)
    for g, values in data.items():
        assert got[g] == pytest.approx(by_sorting(values), rel=1e-12), g


def test_a_hot_key_is_spread(spark):
    """Its rows are counted where they lie: no exchange of the hot way moves more than bins, and nothing sorts or collects its values."""
    df = spark.range(40_000).select(F.lit("a").alias("video"), ((F.col("id") * 7919) % 40_000).alias("d"))
    row = A.duration_stats(df, "d", hot_rows=500).first()
    assert (row.n, row.mean_sec, row.p10_sec, row.p50_sec, row.p90_sec) == (40_000, 20.0, 4.0, 20.0, 35.999)
    assert A.duration_stats(df.limit(0), "d").count() == 0
    plan = _of_hot(df.select("video", F.col("d").cast("double").alias("_v")), [0.5], ["video"], "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "sketch" not in plan
