"""Queries on numeric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import ffill_array, frequency_statistics, int_frac, moving_average, spectrum
from tidemark.operators import series as S
from tidemark.plans import query
from tidemark.sources.tables import finite, hourly_series, table

#: Rows of input, steps ahead, and rows of a season.
INPUT, HORIZONS, SEASON = 48, (6, 12, 24), 24

SERIES_SQL = """hourly AS (SELECT event_type AS domain, date_trunc('hour', ts) AS start_ts, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS ot FROM events GROUP BY 1, 2),
series AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY start_ts) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY domain) AS INT) AS n FROM hourly)"""
#: Targets with gaps: every seventh row and the edges are unknown.
GAPS_SQL = SERIES_SQL + """, gaps AS (SELECT domain, i, n, CASE WHEN i % 7 = 3 OR i < 4 OR i >= n - 2 THEN NULL ELSE ot END AS ot FROM series)"""
SCALED_SQL = SERIES_SQL + """, scaled AS (SELECT *, (ot - avg(CASE WHEN i < floor(n * 0.7::DOUBLE) THEN ot END) OVER w) / stddev_pop(CASE WHEN i < floor(n * 0.7::DOUBLE) THEN ot END) OVER w AS z FROM series WINDOW w AS (PARTITION BY domain))"""


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_positions(hourly_series(spark, sf_dir))


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (F.col("i") % 7 == 3) | (F.col("i") < 4) | (F.col("i") >= F.col("n") - 2)
    return positioned(spark, sf_dir).withColumn("ot", F.when(~gap, F.col("ot")))


def train_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scaled(positioned(spark, sf_dir), int_frac(F.col("n"), 0.7))


def rounded(c: Column | str) -> Column:
    """To six places, zero without a sign."""
    return F.round(c, 6) + F.lit(0.0)


@query(f"""WITH {SERIES_SQL}, d AS (SELECT DISTINCT domain, start_ts FROM hourly),
st AS (SELECT domain, epoch_us(start_ts) / 3600e6 - lag(epoch_us(start_ts) / 3600e6) OVER (PARTITION BY domain ORDER BY start_ts) AS step FROM d),
m AS (SELECT domain, step, count(*) AS c FROM st WHERE step IS NOT NULL GROUP BY domain, step QUALIFY row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, step) = 1)
SELECT s.domain, count(*) AS rows, strftime(min(start_ts), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(max(start_ts), '%Y-%m-%d %H:%M:%S') AS last_start,
count(*) - count(ot) AS missing, count(start_ts) - count(DISTINCT start_ts) AS repeated, any_value(step) AS modal_step FROM hourly s LEFT JOIN m USING (domain) GROUP BY s.domain""")
def series_audit(spark, sf_dir):
    return S.audit(hourly_series(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderpriority AS domain, o_orderdate AS s, o_orderkey AS k FROM orders),
p AS (SELECT domain, s, row_number() OVER (PARTITION BY domain ORDER BY k) AS came, row_number() OVER (PARTITION BY domain ORDER BY s, s, k) AS goes, lag(s) OVER (PARTITION BY domain ORDER BY k) AS b FROM r)
SELECT domain, count(*) AS rows, count(*) FILTER (came <> goes) AS moved, CASE WHEN bool_and(coalesce(s >= b, true)) THEN 'ascending' WHEN bool_and(coalesce(s <= b, true)) THEN 'descending' ELSE 'unsorted' END AS arrival FROM p GROUP BY domain""")
def order_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("domain"), F.col("o_orderdate").alias("start_ts"), F.col("o_orderdate").alias("end_ts"), "o_orderkey")
    return S.order_audit(rows, "start_ts", "end_ts", "o_orderkey")


@query(f"""WITH {GAPS_SQL}, t AS (SELECT domain, i, last_value(ot IGNORE NULLS) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, median(CASE WHEN i < floor(n * 0.7::DOUBLE) THEN ot END) OVER (PARTITION BY domain) AS m FROM gaps)
SELECT domain, i, round(coalesce(f, m), 6) AS filled FROM t""")
def ffill(spark, sf_dir):
    return S.filled(with_gaps(spark, sf_dir), int_frac(F.col("n"), 0.7)).select("domain", "i", rounded("filled").alias("filled"))


@query(f"""WITH {GAPS_SQL}, b AS (SELECT *, min(CASE WHEN ot IS NOT NULL THEN i END) OVER (PARTITION BY domain) AS lo, max(CASE WHEN ot IS NOT NULL THEN i END) OVER (PARTITION BY domain) AS hi FROM gaps)
SELECT domain, i, ot FROM b WHERE i BETWEEN lo AND hi""")
def edge_trim(spark, sf_dir):
    return S.trimmed(with_gaps(spark, sf_dir)).select("domain", "i", "ot")


@query("""WITH v AS (SELECT event_type AS domain, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS ot FROM events)
SELECT domain, count(*) AS rows, count(*) FILTER (isnan(ot) OR isinf(ot)) AS replaced, round(avg(ot) FILTER (NOT isnan(ot) AND NOT isinf(ot)), 6) AS mean FROM v GROUP BY domain""")
def nonfinite_audit(spark, sf_dir):
    bad = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), bad.alias("ot")).withColumn("known", finite(F.col("ot")))
    return rows.groupBy("domain").agg(F.count("*").alias("rows"), F.count_if(F.col("known").isNull()).alias("replaced"), rounded(F.avg("known")).alias("mean"))


@query(f"""WITH {GAPS_SQL}, keyed AS (SELECT domain, i // 2 AS k, ot FROM gaps), c AS (SELECT *, count(*) OVER (PARTITION BY domain, k) AS c FROM keyed)
SELECT domain, k, count(*) AS copies, count(DISTINCT ot) > 1 AS ambiguous FROM c WHERE c > 1 GROUP BY domain, k""")
def ambiguous_duplicates(spark, sf_dir):
    keyed = with_gaps(spark, sf_dir).select("domain", F.floor(F.col("i") / 2).cast("int").alias("k"), "ot")
    counted = keyed.groupBy("domain", "k").agg(F.count("*").alias("copies"), (F.countDistinct("ot") > 1).alias("ambiguous"))
    return counted.where("copies > 1")


@query(f"""WITH {SCALED_SQL}, w AS (SELECT domain, i, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS x, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS y FROM scaled)
SELECT domain, i, CAST(s - 1 AS INT) AS step, round(x[8 - s + 1], 6) + 0.0 AS input, round(y[s], 6) + 0.0 AS truth FROM w, range(1, 5) t(s) WHERE len(x) = 8 AND len(y) = 4""")
def windows_long(spark, sf_dir):
    got = S.windows(train_scaled(spark, sf_dir), 8, 4)
    each = got.select("domain", "i", F.posexplode(F.arrays_zip(F.slice(F.reverse("x"), 1, 4).alias("input"), F.col("y").alias("truth"))).alias("step", "v"))
    return each.select("domain", "i", "step", rounded("v.input").alias("input"), rounded("v.truth").alias("truth"))


@query(f"""WITH {SCALED_SQL}, w AS (SELECT domain, i, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS x FROM scaled),
u AS (SELECT domain, i, p, x[least(8, greatest(1, p + d))] AS v FROM w, range(1, 9) a(p), range(-1, 2) b(d) WHERE len(x) = 8)
SELECT domain, i, CAST(p - 1 AS INT) AS pos, round(avg(v), 6) + 0.0 AS trend FROM u GROUP BY domain, i, p""")
def moving_trend(spark, sf_dir):
    got = S.windows(train_scaled(spark, sf_dir), 8, 1).select("domain", "i", F.posexplode(moving_average(F.col("x"), 3)).alias("pos", "v"))
    return got.select("domain", "i", "pos", rounded("v").alias("trend"))


@query(f"""WITH {SCALED_SQL}, w AS (SELECT domain, i, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS x FROM scaled),
f AS (SELECT domain, i, x FROM w WHERE len(x) = 8), e AS (SELECT domain, i, p, x[p] AS v, i - 9 + p AS at FROM f, range(1, 9) t(p)),
c AS (SELECT domain, i, p, CASE WHEN (i + p) % 3 = 0 THEN NULL ELSE v END AS v FROM e),
r AS (SELECT domain, i, p, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY domain, i ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS v FROM c)
SELECT domain, i, round(sum(v * p), 6) + 0.0 AS digest FROM r GROUP BY domain, i""")
def window_ffill(spark, sf_dir):
    got = S.windows(train_scaled(spark, sf_dir), 8, 1)
    holes = F.transform("x", lambda v, p: F.when((F.col("i") + p + 1) % 3 != 0, v))
    out = got.withColumn("v", ffill_array(holes))
    return out.select("domain", "i", rounded(F.aggregate(F.transform("v", lambda v, p: v * (p + 1)), F.lit(0.0), lambda a, x: a + x)).alias("digest"))


@query(f"""WITH {SCALED_SQL}, w AS (SELECT domain, i, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS x FROM scaled),
x AS (SELECT domain, i, x FROM w WHERE len(x) = 8),
parts AS (SELECT domain, i, k, sum(x[t + 1] * cos(2 * pi() * k * t / 8)) AS re, sum(x[t + 1] * sin(2 * pi() * k * t / 8)) AS im FROM x, range(0, 5) a(k), range(0, 8) b(t) GROUP BY domain, i, k),
p AS (SELECT domain, i, k, re * re + im * im AS p FROM parts), s AS (SELECT *, p / greatest(sum(p) OVER (PARTITION BY domain, i), 1e-8) AS s FROM p),
f AS (SELECT domain, i, sum(CASE WHEN k = 0 THEN s ELSE 0 END) AS band1, sum(CASE WHEN k = 1 THEN s ELSE 0 END) AS band2, sum(CASE WHEN k = 2 THEN s ELSE 0 END) AS band3, sum(CASE WHEN k >= 3 THEN s ELSE 0 END) AS band4,
 sum(s * k / 4) AS centroid, -sum(s * ln(greatest(s, 1e-12))) / ln(5) AS entropy, arg_max(k, p) FILTER (k > 0) / 4 AS dominant, max(s) AS concentration FROM s GROUP BY domain, i),
d AS (SELECT domain, i, stddev_pop(x[t + 1] - x[t]) AS volatility FROM x, range(1, 8) b(t) GROUP BY domain, i)
SELECT domain, i, round(band1, 6) AS band1, round(band2, 6) AS band2, round(band3, 6) AS band3, round(band4, 6) AS band4, round(centroid, 6) AS centroid, round(entropy, 6) AS entropy, round(dominant, 6) AS dominant,
round(concentration, 6) AS concentration, round(x[8] - x[1], 6) + 0.0 AS slope, round(volatility, 6) AS volatility FROM f JOIN d USING (domain, i) JOIN x USING (domain, i)""")
def freq_stats(spark, sf_dir):
    got = S.windows(train_scaled(spark, sf_dir), 8, 1).withColumn("power", spectrum(F.col("x"), 8))
    stats = frequency_statistics(F.col("x"), F.col("power"), 5)
    return got.select("domain", "i", *(rounded(c).alias(k) for k, c in stats.items()))


FOLDS = ((0.4, 0.5, 0.7, 0.8), (0.5, 0.6, 0.8, 0.9), (0.6, 0.7, 0.9, 1.0))


@query(f"""WITH {GAPS_SQL}, folds(fold, a, b, c, d) AS (VALUES (1, 0.4::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE), (2, 0.5::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE), (3, 0.6::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE)),
g AS (SELECT domain, fold, i, floor(n * a) AS a, floor(n * b) AS b, floor(n * c) AS c, CASE WHEN fold = 3 THEN n ELSE floor(n * d) END AS d,
  count(ot) OVER (PARTITION BY domain, fold ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS known FROM gaps, folds),
s AS (SELECT domain, fold, i, known, CASE WHEN i >= 48 AND i + 6 <= a THEN 'train' WHEN i >= a AND i + 6 <= b THEN 'cal' WHEN i >= b AND i + 6 <= c THEN 'dec' WHEN i >= c AND i + 6 <= d THEN 'test' END AS segment, i >= 48 AND i + 6 <= c AS fit FROM g)
SELECT domain, CAST(fold AS INT) AS fold, segment, count(*) AS proposed, count(*) FILTER (known < 6) AS excluded, count(*) FILTER (fit) AS fit FROM s WHERE segment IS NOT NULL GROUP BY domain, fold, segment""")
def fold_segments(spark, sf_dir):
    """Four segments of three rolling folds, with the origins that an unknown target excludes; fit holds straddlers too."""
    rows = with_gaps(spark, sf_dir)
    rows = rows.withColumn("known", F.count("ot").over(S.W.partitionBy("domain").orderBy("i").rowsBetween(0, 5)))
    folds = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("fold"), *S.bounds(F.col("n"), dict(zip("abcd", f)))) for k, f in enumerate(FOLDS))))
    each = rows.select("domain", "i", "known", folds.alias("f")).select("domain", "i", "known", "f.*")
    cuts = [("train", F.lit(INPUT), F.col("a")), ("cal", F.col("a"), F.col("b")), ("dec", F.col("b"), F.col("c")), ("test", F.col("c"), F.col("d"))]
    each = each.withColumn("segment", S.segment(F.col("i"), 6, cuts)).where("segment is not null")
    fit = (F.col("i") >= INPUT) & (F.col("i") + 6 <= F.col("c"))
    return each.groupBy("domain", "fold", "segment").agg(F.count("*").alias("proposed"), F.count_if(F.col("known") < 6).alias("excluded"), F.count_if(fit).alias("fit"))


@query(f"""WITH {SERIES_SQL}, h(horizon) AS (VALUES (6), (12), (24)), o AS (SELECT domain, horizon, i, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS b FROM series, h),
m AS (SELECT *, (a + b) // 2 AS mid, ((a + b) // 2 + b) // 2 AS q FROM o)
SELECT domain, horizon, count(*) FILTER (i >= a AND i + horizon <= mid) AS calibration, count(*) FILTER (i >= mid AND i + horizon <= b) AS decision,
count(*) FILTER (i >= mid AND i + horizon <= least(b, q)) AS first_half, count(*) FILTER (i >= q AND i + horizon <= b) AS second_half FROM m GROUP BY domain, horizon""")
def split_masks(spark, sf_dir):
    rows = positioned(spark, sf_dir).select("domain", "i", int_frac(F.col("n"), 0.7).alias("train_end"), int_frac(F.col("n"), 0.8).alias("validation_end"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"))
    masks = S.half_masks(rows)
    return masks.groupBy("domain", "horizon").agg(*(F.count_if(F.col(c)).alias(c) for c in ("calibration", "decision", "first_half", "second_half")))
