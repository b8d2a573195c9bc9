"""Bands from merged sketches: equal to counting all rows, within the stated errors, unknown where nothing is known."""

import datetime as dt
import random

from pyspark.sql import functions as F

from palisade.operators import summaries as sm

DAY = dt.date(2024, 2, 27)
SCHEMA = "series string, day date, x double, who long"
INDICATORS = (sm.Indicator("median", "x", 0.5, 0.52, 0.5), sm.Indicator("tail", "x", 0.9, 0.91, 0.9), sm.Indicator("people", "who", 40, 60))


def states(df, days=3, k=sm.QUANTILE_K):
    return {(r.series, r.day, r.indicator): (r.state, r.by_rows) for r in sm.states(df, ["series"], "day", INDICATORS, days, k).collect()}


def counted(rows, days=3):
    """Plain counting over the rows of each span."""
    out = {}
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    for series, day in {r[:2] for r in rows}:
        span = [r for r in rows if r[0] == series and 0 <= (day - r[1]).days < days]
        xs = [r[2] for r in span if r[2] is not None and r[2] == r[2]]
        for i in INDICATORS:
            if i.quantile is None:
                n = len({r[3] for r in span if r[3] is not None})
                state = "unknown" if not n else "bad" if n > i.bad else "warn" if n > i.warn else "ok"
            else:
                low = lambda limit: sum(x <= limit for x in xs) < i.quantile * len(xs)  # noqa: B023, E731
                state = "unknown" if not xs else "bad" if low(i.bad) else "warn" if low(i.warn) else "ok"
            out[series, day, i.name] = state
    return out


def test_states_equal_counting(spark):
    rng = random.Random(3)
    rows = []
    for s in range(4):
        for d in range(8):
            if rng.random() < 0.8:
                rows += [(f"s{s}", DAY + dt.timedelta(d), rng.random() + s * 0.006, rng.randrange(25 * (s + 1))) for _ in range(rng.randrange(1, 400))]
    rows += [("nan", DAY, float("nan"), None), ("nan", DAY, None, None), ("s0", None, 1.0, 1), (None, DAY, 1.0, 1), ("one", DAY, 0.7, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = states(df)
    assert {k: v[0] for k, v in got.items()} == counted(rows)
    assert {v[0] for v in got.values()} == {"ok", "warn", "bad", "unknown"}
    assert {v[1] for v in got.values()} == {True, False}  # some by sketch, some by rows
    assert {k: v[0] for k, v in states(df, k=32).items()} == counted(rows)  # rougher sketches, the same answers
    assert {k: v[0] for k, v in states(df.repartition(7), 1).items()} == counted(rows, 1)


def test_errors_are_within_what_is_stated(spark):
    k = 200
    df = spark.range(200_000).select(F.lit("a").alias("series"), F.date_add(F.lit(DAY), (F.col("id") % 10).cast("int")).alias("day"), (F.hash("id") / 2.0**32 + 0.5).alias("x"), (F.col("id") % 30_011).alias("who"))
    one = sm.rolled(sm.summarize(df, ["series"], "day", INDICATORS, k), ["series"], "day", INDICATORS, 10, k).orderBy(F.col("day").desc())
    ranks = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    row = one.select("n_x", F.hll_sketch_estimate("d_who").alias("who"), *(F.kll_sketch_get_rank_double("q_x", F.lit(r)).alias(f"r{i}") for i, r in enumerate(ranks))).first()
    true = df.agg(*(F.avg((F.col("x") <= r).cast("int")).alias(f"r{i}") for i, r in enumerate(ranks))).first()
    assert row.n_x == 200_000 and all(abs(row[f"r{i}"] - true[f"r{i}"]) <= 2 * sm.rank_error(k) for i in range(len(ranks)))
    assert abs(row.who / 30_011 - 1) <= 4 * sm.distinct_error()


def test_one_sketch_says_who_is_counted(spark):
    """Shares that lie at the edge of a rough sketch's doubt: made twice, a sketch told it once this way and once that."""
    k, n = 64, 1000
    least = round(n * (0.5 + 2 * sm.rank_error(k)))
    df = spark.range(200 * n).select((F.col("id") % 200).cast("string").alias("series"), F.lit(DAY).alias("day"), (((F.col("id") / 200).cast("long") + n / 2 - (n - least)) / n).alias("x"), F.lit(1).alias("who"))
    got = {(r.series, r.state) for r in sm.states(df, ["series"], "day", (sm.Indicator("median", "x", 0.5, 2.0, 0.5),), 1, k).collect()}
    assert got == {(str(s), "warn") for s in range(200)}


def test_bands_and_changes(spark):
    at = [DAY + dt.timedelta(i) for i in range(6)]
    table = [["ok", "ok"], ["warn", "warn"], ["bad", "bad"], ["unknown", "unknown"], ["unknown", "bad"], ["ok", "warn"]]
    found = spark.createDataFrame([("s", d, f"i{j}", s) for d, pair in zip(at, table) for j, s in enumerate(pair)], "series string, day date, indicator string, state string")
    got = [(r.band, r.change) for r in sm.bands(found, ["series"], "day").orderBy("day").collect()]
    assert got == [("ok", None), ("warn", "worse"), ("bad", "worse"), ("unknown", None), ("warn", None), ("ok", "better")]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert states(none) == {} and sm.bands(sm.states(none, ["series"], "day", INDICATORS, 2), ["series"], "day").count() == 0
