"""Queries on evidence: resampling, adjusted p-values, gates, and checks of stored results."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import int_frac, long_floor, long_sum
from tidemark.operators import statistics as R
from tidemark.plans import query
from tidemark.plans.forecast import LONG_SQL, error_table, predictions_between, test_predictions
from tidemark.plans.series import positioned, rounded
from tidemark.sources.sealed import evidence_order, freeze, open_frozen
from tidemark.sources.shared import fresh_path
from tidemark.sources.sinks import remaining
from tidemark.sources.tables import finite, table

#: Per test origin of the longest horizon, the squared error that the window's mean saves on the last value.
LOSS_SQL = LONG_SQL + """, loss AS (SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY i) - 1 AS BIGINT) AS i, d FROM (SELECT domain, i, avg(CASE WHEN model = 'Last' THEN (prediction - actual) ** 2 WHEN model = 'WindowMean' THEN -((prediction - actual) ** 2) END) * 2 AS d FROM predictions WHERE horizon = 24 AND model <> 'SeasonalNaive' GROUP BY domain, i))"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("prediction") - F.col("actual")
    signed = F.when(F.col("model") == "Last", e * e).otherwise(-e * e)
    rows = test_predictions(spark, sf_dir).where("horizon = 24 and model <> 'SeasonalNaive'").groupBy("domain", "i").agg((F.avg(signed) * 2).alias("d"))
    return rows.select("domain", (F.row_number().over(R.W.partitionBy("domain").orderBy("i")) - 1).cast("long").alias("i"), "d")


@query(f"""WITH {LOSS_SQL}, b AS (SELECT domain, i // 6 AS b, avg(d) AS m FROM (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM loss) WHERE i // 6 < n // 6 GROUP BY domain, b)
SELECT domain, count(*) AS blocks, round(CASE WHEN count(*) >= 3 THEN 2.8015852181130707 * stddev_samp(m) / sqrt(count(*)) END, 6) AS mde FROM b GROUP BY domain""")
def block_power(spark, sf_dir):
    return R.block_power(losses(spark, sf_dir), ["domain"], 6).select("domain", "blocks", F.round("mde", 6).alias("mde"))


@query(f"""WITH {LOSS_SQL}, pre AS (SELECT domain, i + 1 AS at, sum(d) OVER (PARTITION BY domain ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM loss UNION ALL SELECT DISTINCT domain, 0, 0.0 FROM loss),
z AS (SELECT domain, count(*) AS n, avg(d) AS mean, least(24, count(*)) AS len FROM loss GROUP BY domain), k AS (SELECT *, CAST(ceil(n / len) AS BIGINT) AS blocks FROM z),
g AS (SELECT domain, n, rep, ('0x' || substr(md5('2026|' || rep || '|' || b), 1, 8))::BIGINT % (n - len + 1) AS lo, CASE WHEN b < blocks THEN len ELSE n - (blocks - 1) * len END AS rows FROM k, range(1, 5001) r(rep), LATERAL (SELECT unnest(range(1, blocks + 1)) AS b) t),
m AS (SELECT g.domain, rep, sum(h.s - l.s) / any_value(n) AS m FROM (SELECT *, lo + rows AS hi FROM g) g JOIN pre l ON l.domain = g.domain AND l.at = lo JOIN pre h ON h.domain = g.domain AND h.at = hi GROUP BY g.domain, rep)
SELECT z.domain, n, round(any_value(z.mean), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m JOIN z USING (domain) GROUP BY z.domain, n""")
def block_bootstrap(spark, sf_dir):
    out = R.block_bootstrap(losses(spark, sf_dir), ["domain"], 24, 5000, 2026)
    return out.select("domain", "n", *(rounded(c).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {LOSS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM loss), m AS (SELECT domain, i, n, d, draw, 4 + ('0x' || substr(md5('5|' || draw), 1, 8))::BIGINT % (n - 7) AS sh FROM n CROSS JOIN range(1, 1000) r(draw) WHERE n >= 8), s AS (SELECT a.domain, draw, avg(a.d * b.d) AS score FROM m a JOIN n b ON b.domain = a.domain AND b.i = (a.i - sh + a.n) % a.n GROUP BY a.domain, draw),
al AS (SELECT domain, avg(d * d) AS aligned FROM loss GROUP BY domain) SELECT domain, count(*) AS draws, round((1 + count(*) FILTER (-score <= -aligned)) / (count(*) + 1), 6) AS p FROM s JOIN al USING (domain) GROUP BY domain""")
def circular_null_p(spark, sf_dir):
    """p of the aligned product of a series with itself against 999 drawn circular shifts beyond the guard."""
    rows = losses(spark, sf_dir)
    moved = R.circular_shifts(rows, ["domain"], 4, 999, 5).join(rows.select("domain", F.col("i").alias("moved"), F.col("d").alias("partner")), ["domain", "moved"])
    nulls = moved.groupBy("domain", "draw").agg((-F.avg(F.col("d") * F.col("partner"))).alias("null_score"))
    aligned = rows.groupBy("domain").agg((-F.avg(F.col("d") * F.col("d"))).alias("aligned"))
    return R.empirical_p(nulls.join(aligned, "domain"), ["domain"]).select("domain", "draws", F.round("p", 6).alias("p"))


@query("""WITH v AS (SELECT o_orderpriority AS family, o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE END AS p FROM orders), k AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS r FROM v WHERE p IS NOT NULL)
SELECT family, id, p, round(least(1.0, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY p RANGE UNBOUNDED PRECEDING)), 6) AS holm, round(least(1.0, min(m / r * p) OVER (PARTITION BY family ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS bh FROM k""")
def holm_bh(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 17 != 0, ((F.col("o_orderkey") * 7919) % 1000) / F.lit(1000.0))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"), p.alias("p"))
    out = R.holm_bh(rows, "p", ["family"])
    return out.select("family", "id", "p", F.round("holm", 6).alias("holm"), F.round("bh", 6).alias("bh"))


#: Errors in whole units of 1e-8, so that no order of rows changes a sum; a mean and the one it is held against are both multiplied by both their counts.
CANDIDATES_SQL = """units AS (SELECT l_suppkey AS task, l_linenumber AS line, CAST(floor(CASE WHEN isfinite(l_discount) THEN l_discount END * 1000000 + 0.5) AS BIGINT) AS d, CAST(floor(CASE WHEN isfinite(l_tax) THEN l_tax END * 1000000 + 0.5) AS BIGINT)::HUGEINT * 100 AS t, NOT isfinite(l_discount) OR NOT isfinite(l_tax) AS odd FROM lineitem),
sums AS (SELECT task, u.variant, coalesce(bool_or(odd), false) AS odd, sum(u.v) AS v, sum(t) AS t, count(u.v)::HUGEINT AS vn, count(t)::HUGEINT AS tn,
 sum(u.v) FILTER (line <= 3) AS v1, sum(t) FILTER (line <= 3) AS t1, count(u.v) FILTER (line <= 3) AS vn1, count(t) FILTER (line <= 3) AS tn1, sum(u.v) FILTER (line > 5) AS v2, sum(t) FILTER (line > 5) AS t2, count(u.v) FILTER (line > 5) AS vn2, count(t) FILTER (line > 5) AS tn2
 FROM units, LATERAL (VALUES ('semantic', d::HUGEINT * 80), ('frequency', d::HUGEINT * 79 + 50000)) u(variant, v) GROUP BY task, u.variant),
c AS (SELECT task, variant, CASE WHEN NOT odd THEN v * tn END AS mse, t * vn AS fallback_mse, v1 * tn1 AS mse_first, t1 * vn1 AS fallback_first, v2 * tn2 AS mse_second, t2 * vn2 AS fallback_second, vn * tn AS pairs, (task % 8) / 200.0::DOUBLE AS p FROM sums)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up variants of a task from lineitem: errors on the whole decision span and in its halves, beside the fallback's.

    Comparisons are exact, ties included: values are taken to six places and summed as whole numbers, in units of 1e-8, and
    each mean and its fallback's are multiplied by the counts of both, whose product is pairs. A task with a value that is
    not finite has no error. A variant is discounts times a weight plus a constant, so its sums come from those of discounts.
    A finite value whose millionths no long holds fails the job, as it fails the SQL: floor alone would cut it.
    """
    units = lambda c: long_floor(finite(F.col(c)) * 1000000 + 0.5, f"{c} is too great")
    odd = lambda c: F.col(c).isNotNull() & finite(F.col(c)).isNull()
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_linenumber").alias("line"), units("l_discount").alias("d"), units("l_tax").alias("t"), (odd("l_discount") | odd("l_tax")).alias("odd"))
    spans = {"all": F.lit(True), "first": F.col("line") <= 3, "second": F.col("line") > 5}
    count = lambda v: F.count(v).cast("decimal(12,0)")
    sums = (f(F.when(span, F.col(c))).alias(f"{c}_{part}_{k}") for k, span in spans.items() for c in "dt" for f, part in ((long_sum, "sum"), (count, "n")))
    variants = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(w).cast("decimal(2,0)").alias("weight"), F.lit(plus).cast("decimal(5,0)").alias("plus")) for v, w, plus in (("semantic", 80, 0), ("frequency", 79, 50000))))
    each = rows.groupBy("task").agg(F.bool_or("odd").alias("odd"), *sums).withColumn("v", F.explode(variants))
    # Of 36 digits, so that a comparison with a placebo keeps its two decimal places.
    error = lambda k: ((F.col(f"d_sum_{k}") * F.col("v.weight") + F.col(f"d_n_{k}") * F.col("v.plus")) * F.col(f"t_n_{k}")).cast("decimal(36,0)")
    fallback = lambda k: (F.col(f"t_sum_{k}") * Decimal(100) * F.col(f"d_n_{k}")).cast("decimal(36,0)")
    return each.select(
        "task", "v.variant", F.when(~F.col("odd"), error("all")).alias("mse"), fallback("all").alias("fallback_mse"), *(f(k).alias(f"{name}_{k}") for k in ("first", "second") for name, f in (("mse", error), ("fallback", fallback))),
        (F.col("d_n_all") * F.col("t_n_all")).alias("pairs"), (F.col("task") % 8 / F.lit(200.0)).alias("p"),
    )


@query(f"""WITH {CANDIDATES_SQL}, g AS (SELECT *, coalesce(mse < fallback_mse AND mse_first < fallback_first AND mse_second < fallback_second AND p <= 0.025, false) AS eligible FROM c)
SELECT task, count(*) FILTER (eligible) AS eligible, coalesce(arg_min(variant, (mse, variant = 'frequency')) FILTER (eligible), 'numeric_fallback') AS route FROM g GROUP BY task""")
def gate_route(spark, sf_dir):
    return R.route(R.gate(candidates(spark, sf_dir), ["task"]), ["task"], ["semantic", "frequency"])


_TEST = "i >= floor(n * 0.8::DOUBLE) AND i + horizon <= n"
_BOTH = f"(i >= floor(n * 0.7::DOUBLE) AND i + horizon <= floor(n * 0.8::DOUBLE) OR {_TEST})"


@query(f"""WITH {LONG_SQL.replace(_TEST, _BOTH)}, x AS (SELECT p.domain, i, step, actual, i >= floor(any_value(n) * 0.8::DOUBLE) AS test, max(prediction) FILTER (model = 'Last') AS numeric, max(prediction) FILTER (model = 'WindowMean') AS candidate FROM predictions p JOIN (SELECT domain, max(n) AS n FROM series GROUP BY domain) s ON s.domain = p.domain WHERE horizon = 6 GROUP BY p.domain, i, step, actual),
q AS (SELECT domain, unnest(list_concat([0.0::DOUBLE], quantile_cont(abs(candidate - numeric), [0.5, 0.7, 0.8, 0.9, 0.95, 1.0]))) AS threshold FROM x WHERE NOT test GROUP BY domain), g AS (SELECT DISTINCT domain, threshold, w AS weight FROM q, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) t(w)),
t AS (SELECT x.domain, test, threshold, weight, avg((numeric + CASE WHEN abs(candidate - numeric) <= threshold THEN weight ELSE 0 END * (candidate - numeric) - actual) ** 2) AS mse, avg(CASE WHEN abs(candidate - numeric) <= threshold THEN 1.0 ELSE 0.0 END) AS accepted FROM x JOIN g USING (domain) GROUP BY x.domain, test, threshold, weight),
best AS (SELECT * FROM t WHERE NOT test QUALIFY row_number() OVER (PARTITION BY domain ORDER BY round(mse, 9), threshold, weight) = 1)
SELECT b.domain, round(b.threshold, 6) AS threshold, b.weight, round(b.mse, 6) AS mse, round(b.accepted, 6) AS accepted, round(t.mse, 6) AS test_mse, round(t.accepted, 6) AS test_accepted FROM best b JOIN t ON t.domain = b.domain AND t.threshold = b.threshold AND t.weight = b.weight AND t.test""")
def disagreement_gate(spark, sf_dir):
    """The gate that errs least on the validation span, and what it does on the test span, which it never saw."""

    def points(lo, hi):
        wide = predictions_between(spark, sf_dir, lo, hi).where("horizon = 6").groupBy("domain", "i", "step", "actual").pivot("model", ["Last", "WindowMean"]).agg(F.first("prediction"))
        return wide.withColumnsRenamed({"Last": "numeric", "WindowMean": "candidate"})

    n = F.col("n")
    out = R.disagreement_gate(points(int_frac(n, 0.7), int_frac(n, 0.8)), ["domain"])
    test = R.apply_disagreement_gate(points(int_frac(n, 0.8), n), out.select("domain", "threshold", "weight"), ["domain"])
    out = out.join(test.select("domain", F.col("mse").alias("test_mse"), F.col("accepted").alias("test_accepted")), "domain")
    return out.select("domain", rounded("threshold").alias("threshold"), "weight", *(rounded(c).alias(c) for c in ("mse", "accepted", "test_mse", "test_accepted")))


@query(f"""WITH {LONG_SQL}, s AS (SELECT domain, horizon, model, mse, CASE WHEN horizon = 12 AND model = 'Last' THEN mse * 1.001 WHEN horizon = 6 AND model = 'WindowMean' THEN NULL ELSE mse END AS stored FROM e)
SELECT domain, horizon, model FROM s WHERE NOT coalesce(abs(mse - stored) <= 1e-7 + 1e-6 * abs(stored), mse IS NULL AND stored IS NULL)""")
def tolerance_violations(spark, sf_dir):
    """Recomputed errors that don't agree with stored ones; some stored ones are altered here so that there are some."""
    rows = error_table(spark, sf_dir)
    stored = F.when((F.col("horizon") == 12) & (F.col("model") == "Last"), F.col("mse") * 1.001).when(~((F.col("horizon") == 6) & (F.col("model") == "WindowMean")), F.col("mse"))
    return rows.withColumn("stored", stored).where(~R.within_tolerance(F.col("mse"), F.col("stored"))).select("domain", "horizon", "model")


@query(f"""WITH {LONG_SQL}, c(claim, claimed) AS (VALUES ('rows', 45), ('mean beats last', 45), ('last beats season', 0)), r AS (SELECT count(*) AS rows, count(*) FILTER (model = 'WindowMean' AND mse < last) AS beats, count(*) FILTER (model = 'Last' AND mse < season) AS lb FROM (SELECT *, max(CASE WHEN model = 'Last' THEN mse END) OVER w AS last, max(CASE WHEN model = 'SeasonalNaive' THEN mse END) OVER w AS season FROM e WINDOW w AS (PARTITION BY domain, horizon)))
SELECT claim, CAST(claimed AS BIGINT) AS claimed, CASE claim WHEN 'rows' THEN rows WHEN 'mean beats last' THEN beats ELSE lb END AS counted, claimed = CASE claim WHEN 'rows' THEN rows WHEN 'mean beats last' THEN beats ELSE lb END AS holds FROM c, r""")
def claim_recount(spark, sf_dir):
    """Claims on a result table beside what a recount gives."""
    w = R.W.partitionBy("domain", "horizon")
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("mse"))).over(w)
    rows = error_table(spark, sf_dir).withColumn("last", of("Last")).withColumn("season", of("SeasonalNaive"))
    counts = {"rows": F.count("*"), "mean beats last": F.count_if((F.col("model") == "WindowMean") & (F.col("mse") < F.col("last"))), "last beats season": F.count_if((F.col("model") == "Last") & (F.col("mse") < F.col("season")))}
    claimed = {"rows": 45, "mean beats last": 45, "last beats season": 0}
    one = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(counts.values())))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("claim"), F.lit(claimed[n]).cast("long").alias("claimed"), F.col(f"c{k}").alias("counted")) for k, n in enumerate(counts))))
    return one.select(each.alias("x")).select("x.*").withColumn("holds", F.col("claimed") == F.col("counted"))


@query(f"""WITH {LONG_SQL}, t AS (SELECT DISTINCT domain, horizon, i + step AS target FROM predictions), b AS (SELECT domain, CAST(max(n) AS BIGINT) AS n FROM series GROUP BY domain)
SELECT domain, horizon, count(*) AS targets, count(*) FILTER (target < floor(n * 0.8::DOUBLE)) AS leaked, min(target) AS first_target FROM t JOIN b USING (domain) GROUP BY domain, horizon""")
def leakage_check(spark, sf_dir):
    """Targets of the test forecasts and how many of them lie before the test segment: none may."""
    targets = test_predictions(spark, sf_dir).select("domain", "horizon", (F.col("i") + F.col("step")).alias("target")).distinct()
    size = positioned(spark, sf_dir).groupBy("domain").agg(F.max("n").alias("n"))
    cut = F.floor(F.col("n") * F.lit(0.8))
    return targets.join(size, "domain").groupBy("domain", "horizon").agg(F.count("*").alias("targets"), F.count_if(F.col("target") < cut).alias("leaked"), F.min("target").alias("first_target"))


@query("""WITH a AS (SELECT doc_id AS k, sha256(text) AS h FROM documents), b AS (SELECT doc_id AS k, sha256(CASE WHEN doc_id % 50 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 97 <> 0)
SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state, count(*) AS rows FROM a LEFT JOIN b USING (k) GROUP BY 1""")
def manifest_check(spark, sf_dir):
    """Digests of texts against a stored manifest of which some rows are altered or left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    stored = docs.where("doc_id % 97 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("was"))
    state = F.when(F.col("was").isNull(), "missing").when(F.col("h") != F.col("was"), "changed").otherwise("same")
    return now.join(stored, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


@query("""WITH d AS (SELECT DISTINCT event_type AS domain FROM events), h(horizon) AS (VALUES (6), (12), (24)), f(fold) AS (VALUES (1), (2), (3)), done AS (SELECT DISTINCT event_type AS domain, CASE WHEN user_id % 2 = 0 THEN 6 ELSE 12 END AS horizon, 1 AS fold FROM events)
SELECT d.domain, h.horizon, f.fold FROM d, h, f WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.domain = d.domain AND done.horizon = h.horizon AND done.fold = f.fold)""")
def remaining_tasks(spark, sf_dir):
    """The grid of tasks less those that are done: what a resumed run has to do."""
    events = table(spark, sf_dir, "events")
    grid = events.select(F.col("event_type").alias("domain")).distinct().withColumn("horizon", F.explode(F.array(F.lit(6), F.lit(12), F.lit(24)))).withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    done = events.select(F.col("event_type").alias("domain"), F.when(F.col("user_id") % 2 == 0, 6).otherwise(12).alias("horizon"), F.lit(1).alias("fold"))
    return remaining(grid, done, ("domain", "horizon", "fold"))


@query(f"""WITH {LONG_SQL.replace(_TEST, _BOTH)}, x AS (SELECT p.*, i >= floor(s.n * 0.8::DOUBLE) AS test FROM predictions p JOIN (SELECT domain, max(n) AS n FROM series GROUP BY domain) s ON s.domain = p.domain),
m AS (SELECT domain, horizon, model, test, avg((prediction - actual) ** 2) AS mse FROM x GROUP BY domain, horizon, model, test),
d AS (SELECT * FROM m WHERE NOT test QUALIFY row_number() OVER (PARTITION BY domain, horizon ORDER BY round(mse, 9), model) = 1)
SELECT d.domain, d.horizon, d.model, round(d.mse, 6) AS validation_mse, round(t.mse, 6) AS test_mse, true AS in_order FROM d JOIN m t ON t.domain = d.domain AND t.horizon = d.horizon AND t.model = d.model AND t.test""")
def sealed_test(spark, sf_dir):
    """The model chosen on the validation span, frozen under a seal, and its test errors, which only a sealed decision opens.

    Results are written too; in_order tells by the files' own times that the decisions were frozen before them.
    """
    path, results = fresh_path(spark, "decisions"), fresh_path(spark, "results")
    n, keys = F.col("n"), ["domain", "horizon"]
    errors = lambda rows: rows.groupBy(*keys, "model").agg(F.avg((F.col("prediction") - F.col("actual")) ** 2).alias("mse"))
    seen = errors(predictions_between(spark, sf_dir, int_frac(n, 0.7), int_frac(n, 0.8)))
    best = F.min(F.struct(F.round("mse", 9).alias("m"), "model", "mse"))
    freeze(seen.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.model", F.col("b.mse").alias("validation_mse")), path)
    decided = open_frozen(spark, path)
    decided.join(errors(test_predictions(spark, sf_dir)), [*keys, "model"]).write.parquet(results)
    out = spark.read.parquet(results).join(F.broadcast(evidence_order(spark, path, results)))
    return out.select(*keys, "model", rounded("validation_mse").alias("validation_mse"), rounded("mse").alias("test_mse"), "in_order")
