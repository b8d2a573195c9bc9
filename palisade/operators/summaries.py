"""Series of snapshots as mergeable summaries, and the bands that indicators put them in.

A snapshot keeps a quantile sketch and a sketch of distinct values for each measure, so any span of snapshots is a merge
of small rows and never a second look at their data. Sketches have errors: a state is taken from a sketch only where its
limit lies outside of twice the stated error (for distinct values four standard errors), and the snapshots in doubt, few
by that, are counted over their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.operators.graphs import _cut

#: Sizes of the sketches: the quantile sketch's k and the logarithm of the distinct sketch's registers.
QUANTILE_K, DISTINCT_LG = 800, 14


@dataclass(frozen=True)
class Indicator:
    """warn and bad: limits that the measure's quantile, or its number of distinct values (quantile null), exceeds."""

    name: str
    measure: str
    warn: float
    bad: float
    quantile: float | None = None


def rank_error(k: int = QUANTILE_K) -> float:
    """The published error of a rank in a quantile sketch of this k, at 99 % confidence."""
    return 2.296 / k**0.9723


def distinct_error(lg: int = DISTINCT_LG) -> float:
    """The standard error of a distinct sketch of 2^lg registers, relative."""
    return 1.04 / 2 ** (lg / 2)


def _measures(indicators: Sequence[Indicator]) -> tuple[list[str], list[str]]:
    names = lambda some: sorted({i.measure for i in indicators if (i.quantile is None) == some})
    return names(False), names(True)


def _value(measure: str) -> Column:
    """A measure as a number; what isn't one is null and not counted."""
    x = F.col(measure).cast("double")
    return F.when(~F.isnan(x), x)


def summarize(rows: DataFrame, by: Sequence[str], at: str, indicators: Sequence[Indicator], k: int = QUANTILE_K, lg: int = DISTINCT_LG) -> DataFrame:
    """(by..., at, n_<measure>, q_<measure>, d_<measure>): one row a snapshot, made by partial aggregation.

    Rows without a time are in no snapshot.
    """
    quantiles, distinct = _measures(indicators)
    aggs = [F.count(_value(m)).alias(f"n_{m}") for m in quantiles] + [F.kll_sketch_agg_double(_value(m), F.lit(k)).alias(f"q_{m}") for m in quantiles]
    aggs += [F.hll_sketch_agg(F.col(m).cast("string"), F.lit(lg)).alias(f"d_{m}") for m in distinct]
    return rows.where(F.col(at).isNotNull()).groupBy(*by, at).agg(*aggs)


def _windows(df: DataFrame, at: str, days: int) -> DataFrame:
    """Each row once for each of the spans of `days` days that its day is in; `at` becomes the span's last day."""
    return df.withColumn(at, F.explode(F.sequence(F.col(at), F.date_add(at, days - 1))))


def rolled(summaries: DataFrame, by: Sequence[str], at: str, indicators: Sequence[Indicator], days: int, k: int = QUANTILE_K) -> DataFrame:
    """For each snapshot the merge of those of the `days` days up to it; summaries stay as they are."""
    quantiles, distinct = _measures(indicators)
    aggs = [F.sum(f"n_{m}").alias(f"n_{m}") for m in quantiles] + [F.kll_merge_agg_double(f"q_{m}", F.lit(k)).alias(f"q_{m}") for m in quantiles]
    aggs += [F.hll_union_agg(f"d_{m}").alias(f"d_{m}") for m in distinct]
    spans = _windows(summaries.withColumn("__own", F.col(at)), at, days).groupBy(*by, at).agg(*aggs, F.bool_or(F.col("__own") == F.col(at)).alias("__own"))
    return spans.where("__own").drop("__own")


def _above(i: Indicator, limit: float, k: int, lg: int) -> Column:
    """Whether the indicator exceeds the limit: true, false, or null where the sketch can't tell."""
    if i.quantile is None:
        n = F.hll_sketch_estimate(f"d_{i.measure}").cast("double")
        low, high = n * (1 - 4 * distinct_error(lg)), n * (1 + 4 * distinct_error(lg))
        return F.when(low > limit, True).when(high <= limit, False)
    share = F.when(F.col(f"n_{i.measure}") > 0, F.kll_sketch_get_rank_double(f"q_{i.measure}", F.lit(float(limit))))
    return F.when(share + 2 * rank_error(k) < i.quantile, True).when(share - 2 * rank_error(k) >= i.quantile, False)


def _counted(i: Indicator, limit: str) -> Column:
    if i.quantile is None:
        return F.col(f"c_{i.name}") > getattr(i, limit)
    return F.col(f"{limit}_{i.name}") < i.quantile * F.col(f"n_{i.name}")


def states(rows: DataFrame, by: Sequence[str], at: str, indicators: Sequence[Indicator], days: int, k: int = QUANTILE_K, lg: int = DISTINCT_LG) -> DataFrame:
    """(by..., at, indicator, state, by_rows): ok, warn or bad of each snapshot's last `days` days.

    A quantile exceeds a limit where less than its share of the values lie at or below the limit. An indicator without
    values is `unknown`, never ok. by_rows: whether rows were counted because the limit lies within the sketch's error.
    Groups with a null key are left out: they are no series.
    """
    named = rows.dropna(subset=list(by))
    keys = [*by, at]
    spans = rolled(summarize(named, by, at, indicators, k, lg), by, at, indicators, days, k)
    each = [
        F.struct(
            F.lit(i.name).alias("indicator"), _above(i, i.warn, k, lg).alias("warn"), _above(i, i.bad, k, lg).alias("bad"),
            (F.hll_sketch_estimate(f"d_{i.measure}") if i.quantile is None else F.col(f"n_{i.measure}")).alias("n"),
        )
        for i in indicators
    ]
    # a sketch made twice isn't the same twice: who is in doubt and who was counted have to come from one
    told = _cut(spans.select(*keys, F.inline(F.array(*each))))
    doubt = told.where("n > 0 AND (warn IS NULL OR bad IS NULL)")
    aggs = []
    for i in indicators:
        x = _value(i.measure)
        if i.quantile is None:
            aggs.append(F.count_distinct(F.col(i.measure).cast("string")).alias(f"c_{i.name}"))
        else:
            aggs += [F.count(x).alias(f"n_{i.name}"), F.count_if(x <= i.warn).alias(f"warn_{i.name}"), F.count_if(x <= i.bad).alias(f"bad_{i.name}")]
    spanned = _windows(named.where(F.col(at).isNotNull()), at, days).join(doubt.select(*keys).distinct(), keys, "left_semi")
    exact = spanned.groupBy(*keys).agg(*aggs)
    counted = exact.select(*keys, F.inline(F.array(*(F.struct(F.lit(i.name).alias("indicator"), _counted(i, "warn").alias("warn_rows"), _counted(i, "bad").alias("bad_rows")) for i in indicators))))
    both = told.join(counted, [*keys, "indicator"], "left")
    warn, bad = F.coalesce("warn", "warn_rows"), F.coalesce("bad", "bad_rows")
    state = F.when(F.col("n") == 0, "unknown").when(bad, "bad").when(warn, "warn").otherwise("ok")
    return both.select(*keys, "indicator", state.alias("state"), ((F.col("n") > 0) & (F.col("warn").isNull() | F.col("bad").isNull())).alias("by_rows"))


def bands(found: DataFrame, by: Sequence[str], at: str, many: int = 2) -> DataFrame:
    """(by..., at, band, change): `bad` by `many` bad indicators, `warn` by a bad one or `many` warnings, else ok.

    Without a known indicator the band is unknown. change: better, worse or same against the series' snapshot before;
    null for its first and next to an unknown one.
    """
    n = lambda s: F.count_if(F.col("state") == s)
    band = F.when(F.count_if(F.col("state") != "unknown") == 0, "unknown").when(n("bad") >= many, "bad").when((n("bad") > 0) | (n("warn") >= many), "warn").otherwise("ok")
    each = found.groupBy(*by, at).agg(band.alias("band"))
    rank = F.when(F.col("band") == "ok", 0).when(F.col("band") == "warn", 1).when(F.col("band") == "bad", 2)
    before = F.lag(rank).over(Window.partitionBy(*by).orderBy(at))
    return each.withColumn("change", F.when(rank > before, "worse").when(rank < before, "better").when(rank == before, "same"))
