"""Queries on loading and preparing series: channels, strict hourly series, composed preparation, files and vectors by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import int_frac
from tidemark.operators import series as S
from tidemark.plans import query
from tidemark.plans.series import GAPS_SQL, HORIZONS, INPUT, SERIES_SQL, positioned, rounded, with_gaps
from tidemark.plans.text import PIT_SQL, index
from tidemark.sources.tables import table

#: Channels of an hourly series beside its target; some are made so that they have to go: constant, or empty in training.
CHANNELS_SQL = """wide AS (SELECT event_type AS domain, date_trunc('hour', ts) AS start_ts, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS events, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, 1.0::DOUBLE AS constant, CAST(NULL AS DOUBLE) AS empty FROM events GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY start_ts) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY domain) AS INT) AS n FROM wide),
tall AS (SELECT domain, i, n, u.channel, CASE WHEN i % 5 = 2 THEN NULL ELSE u.value END AS value FROM placed, LATERAL (VALUES ('total', total), ('events', events), ('users', users), ('constant', constant), ('empty', empty)) u(channel, value))"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value", "user_id")
    hour = F.date_trunc("hour", "ts").cast("timestamp").alias("start_ts")
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    wide = events.groupBy(F.col("event_type").alias("domain"), hour).agg(total.alias("total"), F.count("*").cast("double").alias("events"), F.countDistinct("user_id").cast("double").alias("users"))
    wide = S.with_positions(wide.withColumn("constant", F.lit(1.0)).withColumn("empty", F.lit(None).cast("double")))
    names = ["total", "events", "users", "constant", "empty"]
    return wide.unpivot(["domain", "i", "n"], names, "channel", "value").withColumn("value", F.when(F.col("i") % 5 != 2, F.col("value")))


@query(f"""WITH {CHANNELS_SQL}, kept AS (SELECT domain, channel, stddev_pop(value) AS s, avg(value) AS plain, median(value) AS m FROM tall WHERE i < floor(n * 0.7::DOUBLE) GROUP BY domain, channel HAVING coalesce(stddev_samp(value), 0) > 1e-8),
f AS (SELECT t.domain, t.channel, i, n, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY t.domain, t.channel ORDER BY i ROWS UNBOUNDED PRECEDING), m) AS v FROM tall t JOIN kept USING (domain, channel)),
z AS (SELECT *, avg(CASE WHEN i < floor(n * 0.7::DOUBLE) THEN v END) OVER w AS mean, stddev_pop(CASE WHEN i < floor(n * 0.7::DOUBLE) THEN v END) OVER w AS std FROM f WINDOW w AS (PARTITION BY domain, channel))
SELECT domain, channel, i, round((v - mean) / std, 6) + 0.0 AS z FROM z""")
def multichannel_load(spark, sf_dir):
    out = S.scaled_channels(channels(spark, sf_dir), int_frac(F.col("n"), 0.7))
    return out.select("domain", "channel", "i", rounded("z").alias("z"))


@query(f"""WITH {CHANNELS_SQL} SELECT channel, count(*) AS rows, count(value) AS known FROM tall GROUP BY channel HAVING count(value) > 0""")
def known_columns(spark, sf_dir):
    """Columns that hold a value at all; one aggregate decides for all of them."""
    tall = channels(spark, sf_dir)
    wide = tall.groupBy("domain", "i").pivot("channel", ["total", "events", "users", "constant", "empty"]).agg(F.first("value"))
    kept = S.drop_empty_columns(wide)
    names = [c for c in kept.columns if c not in ("domain", "i")]
    return kept.unpivot(["domain", "i"], names, "channel", "value").groupBy("channel").agg(F.count("*").alias("rows"), F.count("value").alias("known"))


@query("""WITH r AS (SELECT event_type AS domain, date_trunc('hour', ts) AS s, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v, min(event_id) AS k FROM events GROUP BY 1, 2), p AS (SELECT *, lag(s) OVER (PARTITION BY domain ORDER BY s, k) AS b FROM r)
SELECT domain, count(*) AS rows, count(*) FILTER (b = s) AS repeated, count(*) FILTER (epoch_us(s) - epoch_us(b) > 3600000000) AS gaps, count(*) - count(v) AS missing, count(*) >= 100 AND count(*) FILTER (b = s) = 0 AND count(*) = count(v) AS holds FROM p GROUP BY domain""")
def strict_hourly(spark, sf_dir):
    """What a strict hourly load demands, per series: enough rows, no hour twice, none unknown; gaps are counted."""
    return S.hourly_audit(positioned(spark, sf_dir), least_rows=100)


@query(f"""WITH {SERIES_SQL} SELECT domain, i, ot FROM series""")
def asserted_series(spark, sf_dir):
    """A series whose rows are checked as they pass: one that broke a rule would fail the job."""
    rows = positioned(spark, sf_dir)
    rules = {"a start is unknown": F.col("start_ts").isNotNull(), "a target isn't finite": ~F.isnan("ot") & (F.abs("ot") < F.lit(float("inf"))), "a position is out of its series": (F.col("i") >= 0) & (F.col("i") < F.col("n"))}
    return S.demand(rows, rules).select("domain", "i", "ot")


@query(f"""WITH {GAPS_SQL}, raw AS (SELECT domain, i, i // 2 AS k, CASE WHEN i % 29 = 5 THEN 'Infinity'::DOUBLE ELSE ot END AS ot FROM gaps), fin AS (SELECT domain, i, k, CASE WHEN isinf(ot) THEN NULL ELSE ot END AS ot FROM raw),
one AS (SELECT domain, k, CASE WHEN count(DISTINCT ot) > 1 THEN NULL ELSE arg_min(ot, i) END AS ot FROM fin GROUP BY domain, k), first AS (SELECT o.domain, o.k, CASE WHEN o.ot IS NULL THEN NULL ELSE (SELECT f.ot FROM fin f WHERE f.domain = o.domain AND f.k = o.k ORDER BY f.i LIMIT 1) END AS ot FROM one o),
b AS (SELECT *, min(CASE WHEN ot IS NOT NULL THEN k END) OVER (PARTITION BY domain) AS lo, max(CASE WHEN ot IS NOT NULL THEN k END) OVER (PARTITION BY domain) AS hi FROM first)
SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY k) - 1 AS INT) AS i, CAST(k AS INT) AS k, ot FROM b WHERE k BETWEEN lo AND hi""")
def prepared_series(spark, sf_dir):
    """The whole preparation in one: infinities to null, ambiguous repeats to null, the first of each, edges trimmed, placed anew."""
    raw = with_gaps(spark, sf_dir).select("domain", "i", F.floor(F.col("i") / 2).cast("int").alias("k"), F.when(F.col("i") % 29 == 5, F.lit(float("inf"))).otherwise(F.col("ot")).alias("ot"))
    return S.prepared(raw, "k", "i").select("domain", "i", "k", "ot")


@query("""SELECT 'events.parquet' AS file, count(*) AS rows FROM events UNION ALL SELECT 'orders.parquet', count(*) FROM orders UNION ALL SELECT 'labels.parquet', count(*) FROM labels""")
def file_listing(spark, sf_dir):
    """Files as data: the tables that rows come from, by the scan's own metadata, with their rows."""
    names = ("events", "orders", "labels")
    each = [table(spark, sf_dir, n).select(F.regexp_extract("_metadata.file_path", r"([^/]+\.parquet)", 1).alias("file")).groupBy("file").agg(F.count("*").alias("rows")) for n in names]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""SELECT d.lang AS domain, count(*) AS facts, count(e.vec_id) AS with_vector, count(*) - count(e.vec_id) AS without, round(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS mean_norm FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.lang""")
def fact_vectors(spark, sf_dir):
    """Facts joined to their own vectors by id; a fact without one is counted, not lost."""
    facts, vectors = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")), table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return facts.join(vectors, F.col("vec_id") == F.col("doc_id"), "left").groupBy("domain").agg(F.count("*").alias("facts"), F.count("vec_id").alias("with_vector"), F.count_if(F.col("vec_id").isNull()).alias("without"), F.round(F.avg(norm), 6).alias("mean_norm"))


@query(f"""WITH {PIT_SQL}, w AS (SELECT domain, i, list(ot) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN {INPUT} PRECEDING AND 1 PRECEDING) AS x FROM series), a AS (SELECT domain, i FROM w WHERE len(x) = {INPUT})
SELECT a.domain, count(*) AS origins, count(idx.i) AS aligned, count(*) = count(idx.i) AS whole, sum(report_available)::BIGINT AS reports FROM a LEFT JOIN idx ON idx.domain = a.domain AND idx.i = a.i GROUP BY a.domain""")
def origin_alignment(spark, sf_dir):
    """Rows of the text index picked for the origins of windows by domain and origin: none may be lost."""
    series = positioned(spark, sf_dir)
    origins = series.where(F.col("i") >= INPUT).select("domain", "i")
    texts = index(spark, sf_dir).select("domain", "i", "report_available", F.lit(True).alias("found"))
    out = origins.join(texts, ["domain", "i"], "left").groupBy("domain")
    return out.agg(F.count("*").alias("origins"), F.count("found").alias("aligned"), (F.count("*") == F.count("found")).alias("whole"), F.sum("report_available").alias("reports"))


@query(f"""WITH {SERIES_SQL}, h(horizon) AS (VALUES (6), (12), (24)), m(month) AS (VALUES (24)), s AS (SELECT domain, horizon, CASE WHEN i >= {INPUT} AND i + horizon <= 12 * month THEN 'train' WHEN i >= 12 * month AND i + horizon <= 16 * month THEN 'validation' WHEN i >= 16 * month AND i + horizon <= 20 * month THEN 'test' END AS split FROM series, h, m)
SELECT domain, horizon, split, count(*) AS origins FROM s WHERE split IS NOT NULL GROUP BY domain, horizon, split""")
def hour_count_split(spark, sf_dir):
    """A split by fixed counts of hours, 12, 4 and 4 months of rows; a month has a day's hours here, as the series are short."""
    rows = positioned(spark, sf_dir).select("domain", "i", F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"))
    split = S.fixed_split(F.col("i"), F.col("horizon"), INPUT, {"train": 12 * 24, "validation": 4 * 24, "test": 4 * 24})
    return rows.withColumn("split", split).where("split is not null").groupBy("domain", "horizon", "split").agg(F.count("*").alias("origins"))


@query(f"""WITH {SERIES_SQL}, f(fold, lo, hi) AS (VALUES (1, 0.7::DOUBLE, 0.8::DOUBLE), (2, 0.8::DOUBLE, 0.9::DOUBLE), (3, 0.9::DOUBLE, 1.0::DOUBLE)), o AS (SELECT domain, fold, i FROM series, f WHERE i >= floor(n * lo) AND i + 6 <= CASE WHEN fold = 3 THEN n ELSE floor(n * hi) END),
t AS (SELECT DISTINCT domain, fold, i + k AS target FROM o, range(0, 6) r(k)), c AS (SELECT domain, target, count(*) AS folds FROM t GROUP BY domain, target) SELECT domain, count(*) AS targets, count(*) FILTER (folds > 1) AS shared FROM c GROUP BY domain""")
def fold_targets_disjoint(spark, sf_dir):
    """Targets of the test segments of three folds, and how many two folds share: none may be."""
    from tidemark.plans.series import FOLDS

    rows = positioned(spark, sf_dir)
    folds = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("fold"), *S.bounds(F.col("n"), {"lo": f[2], "hi": f[3]})) for k, f in enumerate(FOLDS))))
    tests = rows.select("domain", "i", folds.alias("f")).where((F.col("i") >= F.col("f.lo")) & (F.col("i") + 6 <= F.col("f.hi")))
    return S.shared_targets(tests.select("domain", F.col("f.fold").alias("fold"), "i"), 6)


@query(f"""WITH {SERIES_SQL}, o AS (SELECT domain, horizon, i, floor(n * 0.7::DOUBLE) AS a, floor(n * 0.8::DOUBLE) AS b FROM series, (VALUES (6), (12), (24)) h(horizon) WHERE i >= {INPUT})
SELECT domain, horizon, count(*) FILTER (i + horizon <= a) AS train, count(*) FILTER (i >= a AND i + horizon <= b) AS validation, count(*) FILTER (i + horizon <= a OR i >= a AND i + horizon <= b) AS refit, count(*) FILTER (i + horizon <= b) AS fit, count(*) FILTER (i < a AND i + horizon > a AND i + horizon <= b) AS straddling FROM o GROUP BY domain, horizon""")
def refit_rows(spark, sf_dir):
    """Training and validation rows put together for a refit, without the windows that straddle the cut, beside those with them."""
    rows = positioned(spark, sf_dir).where(F.col("i") >= INPUT).select("domain", "i", int_frac(F.col("n"), 0.7).alias("a"), int_frac(F.col("n"), 0.8).alias("b"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"))
    end = F.col("i") + F.col("horizon")
    train, validation = rows.where(end <= F.col("a")).withColumn("part", F.lit("train")), rows.where((F.col("i") >= F.col("a")) & (end <= F.col("b"))).withColumn("part", F.lit("validation"))
    refit = train.unionByName(validation).groupBy("domain", "horizon").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "validation").alias("validation"), F.count("*").alias("refit"))
    fit = rows.where(end <= F.col("b")).groupBy("domain", "horizon").agg(F.count("*").alias("fit"), F.count_if((F.col("i") < F.col("a")) & (end > F.col("a"))).alias("straddling"))
    return fit.join(refit, ["domain", "horizon"], "left").select("domain", "horizon", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("train", "validation", "refit")), "fit", "straddling")
