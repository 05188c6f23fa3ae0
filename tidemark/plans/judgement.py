"""Queries that judge: selections, gates and their replay, paired comparisons, resampling, corruptions, extremes and classes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import int_frac
from tidemark.operators import forecast as M, ridge, series as S, statistics as R
from tidemark.plans import query
from tidemark.plans.evidence import CANDIDATES_SQL, LOSS_SQL, candidates, losses
from tidemark.plans.forecast import LONG_SQL, error_table, predictions_between, test_predictions
from tidemark.plans.series import INPUT, SCALED_SQL, rounded, train_scaled
from tidemark.plans.text import DOCS_SQL, PIT_SQL, VALID_SQL, index, raw_texts
from tidemark.functions.text import is_valid

CAL_SQL = LONG_SQL.replace("i >= floor(n * 0.8::DOUBLE) AND i + horizon <= n", "i >= floor(n * 0.7::DOUBLE) AND i + horizon <= floor(n * 0.8::DOUBLE)")
MODELS = ["Last", "SeasonalNaive", "WindowMean"]


@query(f"""WITH {CAL_SQL} SELECT domain, horizon, model, round(mse, 6) AS calibration_mse FROM e QUALIFY row_number() OVER (PARTITION BY domain, horizon ORDER BY mse, CASE model WHEN 'Last' THEN 1 WHEN 'SeasonalNaive' THEN 2 ELSE 3 END) = 1""")
def numeric_fallback(spark, sf_dir):
    """The numeric model of least error on the calibration span, which the test span doesn't see; the first of equals."""
    n = F.col("n")
    errors = M.errors(predictions_between(spark, sf_dir, int_frac(n, 0.7), int_frac(n, 0.8)), ["domain", "horizon", "model"])
    return M.winners(errors, ["domain", "horizon"], MODELS).select("domain", "horizon", "model", rounded("mse").alias("calibration_mse"))


@query(f"""WITH {LONG_SQL}, k AS (SELECT *, dense_rank() OVER (PARTITION BY domain, horizon ORDER BY i DESC) AS r FROM predictions) SELECT domain, horizon, model, count(DISTINCT i) AS origins, round(avg((prediction - actual) ** 2), 6) AS mse FROM k WHERE r <= 32 GROUP BY domain, horizon, model""")
def last_origins(spark, sf_dir):
    """Errors over the last 32 test origins of each series and horizon."""
    rows = test_predictions(spark, sf_dir)
    origins = rows.select("domain", "horizon", "i").distinct()
    tail = origins.withColumn("r", F.row_number().over(S.W.partitionBy("domain", "horizon").orderBy(F.desc("i")))).where("r <= 32").drop("r")
    e = F.col("prediction") - F.col("actual")
    return rows.join(tail, ["domain", "horizon", "i"]).groupBy("domain", "horizon", "model").agg(F.countDistinct("i").alias("origins"), rounded(F.avg(e * e)).alias("mse"))


@query(f"""WITH {LONG_SQL} SELECT 'least' AS which, domain, horizon, model, round(mse, 6) AS mse FROM (SELECT * FROM e ORDER BY mse, domain, horizon, model LIMIT 1) UNION ALL SELECT 'greatest', domain, horizon, model, round(mse, 6) FROM (SELECT * FROM e ORDER BY mse DESC, domain, horizon, model LIMIT 1)""")
def global_extremes(spark, sf_dir):
    """The rows of least and greatest error over the whole table, the first by key among equals; one aggregate, no sort."""
    key = F.struct("domain", "horizon", "model")
    both = error_table(spark, sf_dir).agg(F.min(F.struct("mse", key.alias("k"))).alias("lo"), F.min(F.struct((-F.col("mse")).alias("mse"), key.alias("k"))).alias("hi"))
    rows = both.select(F.explode(F.array(F.struct(F.lit("least").alias("which"), F.col("lo.k").alias("k"), F.col("lo.mse").alias("mse")), F.struct(F.lit("greatest").alias("which"), F.col("hi.k").alias("k"), (-F.col("hi.mse")).alias("mse")))).alias("x"))
    return rows.select("x.which", "x.k.*", rounded("x.mse").alias("mse"))


@query(f"""WITH {LONG_SQL}, w AS (SELECT domain, horizon, max(mse) FILTER (model = 'Last') AS a, max(mse) FILTER (model = 'SeasonalNaive') AS b, CASE WHEN horizon = 24 THEN NULL ELSE max(mse) FILTER (model = 'WindowMean') END AS c FROM e GROUP BY domain, horizon)
SELECT domain, horizon, round(least(a, b, c), 6) AS best FROM w""")
def rowwise_least(spark, sf_dir):
    """The least of several columns of a row; unknown ones are passed over."""
    wide = error_table(spark, sf_dir).groupBy("domain", "horizon").pivot("model", MODELS).agg(F.first("mse"))
    return wide.select("domain", "horizon", rounded(F.least("Last", "SeasonalNaive", F.when(F.col("horizon") != 24, F.col("WindowMean")))).alias("best"))


#: Labels of domains, and what stands for one that isn't listed.
LABELS = {"click": "Clicks", "error": "Errors", "purchase": "Purchases"}


@query(f"""WITH {LONG_SQL} SELECT DISTINCT domain, horizon, CASE domain WHEN 'click' THEN 'Clicks' WHEN 'error' THEN 'Errors' WHEN 'purchase' THEN 'Purchases' ELSE domain END || '-' || horizon AS label FROM e""")
def recoded_labels(spark, sf_dir):
    """Keys recoded by a map of labels and joined to a text; a key without a label stays."""
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    label = F.concat_ws("-", F.coalesce(names[F.col("domain")], F.col("domain")), F.col("horizon").cast("string"))
    return error_table(spark, sf_dir).select("domain", "horizon").distinct().withColumn("label", label)


#: Block lengths of the paired comparisons, their repeats and seed.
LENGTHS, REPEATS, SEED = (6, 12, 24), 5000, 77
PAIRS_SQL = LONG_SQL + """, paired AS (SELECT c.against, p.domain, CAST(row_number() OVER (PARTITION BY c.against, p.domain ORDER BY p.i) - 1 AS BIGINT) AS i, avg(CASE WHEN p.model = c.against THEN (prediction - actual) ** 2 ELSE -((prediction - actual) ** 2) END) * 2 AS d
 FROM predictions p, (VALUES ('Last'), ('SeasonalNaive')) c(against) WHERE horizon = 24 AND p.model IN (c.against, 'WindowMean') GROUP BY c.against, p.domain, p.i)"""
COMPARED_SQL = (
    PAIRS_SQL
    + f""", pre AS (SELECT against, domain, i + 1 AS at, sum(d) OVER (PARTITION BY against, domain ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM paired UNION ALL SELECT DISTINCT against, domain, 0, 0.0 FROM paired),
z AS (SELECT against, domain, block, count(*) AS n, avg(d) AS mean, least(block, count(*)) AS len FROM paired, (VALUES (6), (12), (24)) b(block) GROUP BY against, domain, block), k AS (SELECT *, CAST(ceil(n / len) AS BIGINT) AS blocks FROM z),
g AS (SELECT against, domain, block, n, rep, ('0x' || substr(md5('{SEED}|' || rep || '|' || b), 1, 8))::BIGINT % (n - len + 1) AS lo, CASE WHEN b < blocks THEN len ELSE n - (blocks - 1) * len END AS rows FROM k, range(1, {REPEATS + 1}) r(rep), LATERAL (SELECT unnest(range(1, blocks + 1)) AS b) t),
m AS (SELECT g.against, g.domain, block, rep, sum(h.s - l.s) / any_value(n) AS m FROM (SELECT *, lo + rows AS hi FROM g) g JOIN pre l ON l.against = g.against AND l.domain = g.domain AND l.at = lo JOIN pre h ON h.against = g.against AND h.domain = g.domain AND h.at = hi GROUP BY g.against, g.domain, block, rep),
compared AS (SELECT m.against, m.domain, m.block, any_value(z.mean) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m JOIN z USING (against, domain, block) GROUP BY m.against, m.domain, m.block)"""
)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per comparison and test origin of the longest horizon, the squared error that the window's mean saves on a simple model."""
    rows = test_predictions(spark, sf_dir).where("horizon = 24").withColumn("against", F.explode(F.array(F.lit("Last"), F.lit("SeasonalNaive"))))
    e = F.col("prediction") - F.col("actual")
    signed = F.when(F.col("model") == F.col("against"), e * e).otherwise(-e * e)
    out = rows.where((F.col("model") == F.col("against")) | (F.col("model") == "WindowMean")).groupBy("against", "domain", "i").agg((F.avg(signed) * 2).alias("d"))
    return out.select("against", "domain", (F.row_number().over(S.W.partitionBy("against", "domain").orderBy("i")) - 1).cast("long").alias("i"), "d")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, out = ["against", "domain"], None
    rows = paired(spark, sf_dir)
    for length in LENGTHS:
        one = R.block_bootstrap(rows, keys, length, REPEATS, SEED).withColumn("block", F.lit(length))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {COMPARED_SQL} SELECT against, domain, block, round(mean, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM compared""")
def paired_comparisons(spark, sf_dir):
    return compared(spark, sf_dir).select("against", "domain", "block", *(rounded(c).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {COMPARED_SQL} SELECT domain, bool_and(low > 0) AS joint, count(*) FILTER (low > 0) AS above, count(*) AS comparisons FROM compared GROUP BY domain""")
def joint_flag(spark, sf_dir):
    """Whether a candidate beats every control at every block length with an interval above 0."""
    return compared(spark, sf_dir).groupBy("domain").agg(F.bool_and(F.col("low") > 0).alias("joint"), F.count_if(F.col("low") > 0).alias("above"), F.count("*").alias("comparisons"))


@query(f"""WITH {COMPARED_SQL} SELECT against, domain, block, CASE WHEN low > 0 THEN 'gain' WHEN high < 0 THEN 'loss' ELSE 'open' END AS class FROM compared""")
def interval_class(spark, sf_dir):
    """What an interval tells: a gain above 0, a loss below, else open."""
    return compared(spark, sf_dir).select("against", "domain", "block", F.when(F.col("low") > 0, "gain").when(F.col("high") < 0, "loss").otherwise("open").alias("class"))


@query(f"""WITH {LOSS_SQL}, z AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM loss), g AS (SELECT domain, n, rep, i, ('0x' || substr(md5('9|' || rep || '|' || i), 1, 8))::BIGINT % n AS pick FROM z, range(1, 1001) r(rep)),
m AS (SELECT g.domain, rep, avg(l.d) AS m FROM g JOIN loss l ON l.domain = g.domain AND l.i = g.pick GROUP BY g.domain, rep) SELECT domain, count(*) AS repeats, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m GROUP BY domain""")
def iid_bootstrap(spark, sf_dir):
    out = R.iid_bootstrap(losses(spark, sf_dir), ["domain"], 1000, 9)
    return out.select("domain", "repeats", rounded("low").alias("low"), rounded("high").alias("high"))


@query(f"""WITH {PIT_SQL}, a AS (SELECT domain, i, report_available + search_available AS texts, i - min(i) OVER (PARTITION BY domain) AS p FROM idx), od AS (SELECT domain, p, row_number() OVER (PARTITION BY domain ORDER BY md5('31|' || p), p) - 1 AS at FROM a),
s AS (SELECT a.domain, a.texts AS own, b.texts AS other, od.p AS moved_from, od.at AS moved_to FROM od JOIN a ON a.domain = od.domain AND a.p = od.at JOIN a b ON b.domain = od.domain AND b.p = od.p)
SELECT domain, count(*) AS origins, count(*) FILTER (moved_from <> moved_to) AS moved, sum(own)::BIGINT AS texts, sum(other)::BIGINT AS shuffled_texts, round(sum(own * other) / greatest(sum(own * own), 1), 6) AS likeness FROM s GROUP BY domain""")
def shuffled_texts(spark, sf_dir):
    """A probe's control: texts dealt to other origins of their series by a seeded shuffle; no text is lost, few stay."""
    rows = index(spark, sf_dir).select("domain", "i", (F.col("report_available") + F.col("search_available")).alias("texts"))
    out = R.shuffled(rows, ["domain"], "i", "texts", 31)
    own, other = F.col("texts"), F.col("shuffled")
    return out.groupBy("domain").agg(F.count("*").alias("origins"), F.count_if(F.col("from") != F.col("at")).alias("moved"), F.sum(own).alias("texts"), F.sum(other).alias("shuffled_texts"), F.round(F.sum(own * other) / F.greatest(F.sum(own * own), F.lit(1)), 6).alias("likeness"))


@query(f"""WITH {CANDIDATES_SQL}, g AS (SELECT task, variant, mse, fallback_mse, coalesce(mse < fallback_mse AND 100 * mse < 101 * fallback_mse - (task % 8) * 1000000 * pairs AND mse_first < fallback_first AND mse_second < fallback_second, false) AS chosen FROM c)
SELECT task, count(*) FILTER (chosen) AS chosen, coalesce(arg_min(variant, (mse, variant)) FILTER (chosen), 'numeric') AS variant FROM g GROUP BY task""")
def development_gate(spark, sf_dir):
    """The development gate: better than the numeric model, than the mean placebo, and in both halves; the placebo is made here.

    It is the fallback's mean times 1.01, less a ten-thousandth for each unit of the task's number modulo 8.
    """
    less = (F.col("task") % 8 * 10000).cast("decimal(6,0)") * F.col("pairs")
    rows = candidates(spark, sf_dir).withColumn("placebo_mse", F.col("fallback_mse") * Decimal("1.01") - less)
    return R.development_gate(rows, ["task"])


@query(f"""WITH {CANDIDATES_SQL}, g AS (SELECT *, coalesce(mse < fallback_mse AND mse_first < fallback_first AND mse_second < fallback_second AND p <= 0.025, false) AS eligible FROM c),
r AS (SELECT task, coalesce(arg_min(variant, (mse, variant = 'frequency')) FILTER (eligible), 'numeric_fallback') AS route FROM g GROUP BY task), s AS (SELECT task, route, CASE WHEN task % 10 = 3 THEN 'semantic' WHEN task % 10 = 7 THEN NULL ELSE route END AS stored FROM r)
SELECT task, route, stored FROM s WHERE route IS DISTINCT FROM stored""")
def gate_replay(spark, sf_dir):
    """Decisions made again from the stored errors, and where they differ from the stored decisions, some altered here."""
    routes = R.route(R.gate(candidates(spark, sf_dir), ["task"]), ["task"], ["semantic", "frequency"]).select("task", "route")
    stored = F.when(F.col("task") % 10 == 3, "semantic").when(~(F.col("task") % 10).eqNullSafe(7), F.col("route"))
    return routes.withColumn("stored", stored).where(~F.col("route").eqNullSafe(F.col("stored")))


@query(f"""WITH {CANDIDATES_SQL}, g AS (SELECT *, coalesce(mse < fallback_mse AND mse_first < fallback_first AND mse_second < fallback_second AND p <= 0.025, false) AS eligible FROM c), r AS (SELECT task, coalesce(arg_min(variant, (mse, variant = 'frequency')) FILTER (eligible), 'numeric_fallback') AS route FROM g GROUP BY task)
SELECT (task - ((task % 100) + 100) % 100) // 100 AS part, count(*) AS decisions, sha256(string_agg(coalesce(CAST(task AS VARCHAR), '') || '=' || route, ';' ORDER BY task)) AS seal FROM r GROUP BY 1""")
def frozen_decisions(spark, sf_dir):
    """A seal on the decisions, taken before any test error is known: a digest per hundred tasks, to be compared later.

    A task without a number is sealed too, under an empty name.
    """
    routes = R.route(R.gate(candidates(spark, sf_dir), ["task"]), ["task"], ["semantic", "frequency"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", F.concat(F.coalesce(F.col("task").cast("string"), F.lit("")), F.lit("="), "route").alias("line")))), lambda x: x["line"]), ";")
    return routes.groupBy(F.expr("(task - pmod(task, 100)) div 100").alias("part")).agg(F.count("*").alias("decisions"), F.sha2(lines, 256).alias("seal"))


@query(f"""WITH {LONG_SQL}, b AS (SELECT *, 1 - mse / max(CASE WHEN model = 'SeasonalNaive' THEN mse END) OVER (PARTITION BY domain, horizon) AS skill FROM e)
SELECT domain, horizon, model, round(exp(-mse) / sum(exp(-mse)) OVER (PARTITION BY domain, horizon), 6) AS softmax, round(1 / (1 + exp(-skill)), 6) AS sigmoid, round(tanh(skill), 6) + 0.0 AS tanh, round(greatest(-0.5, least(0.5, skill)), 6) + 0.0 AS clipped FROM b""")
def squashed_scores(spark, sf_dir):
    """Scores squashed: softmax of the errors' negatives over the models of a task, sigmoid, tanh and clipping of the skill."""
    rows = M.skill(error_table(spark, sf_dir), ["domain", "horizon"], "SeasonalNaive")
    weight, skill = F.exp(-F.col("mse")), F.col("skill")
    share = weight / F.sum(weight).over(S.W.partitionBy("domain", "horizon"))
    return rows.select("domain", "horizon", "model", F.round(share, 6).alias("softmax"), F.round(1 / (1 + F.exp(-skill)), 6).alias("sigmoid"), rounded(F.tanh(skill)).alias("tanh"), rounded(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), skill))).alias("clipped"))


@query(f"""WITH {DOCS_SQL}, v AS (SELECT source, start_ts, end_ts, count(*) AS c FROM raw WHERE {VALID_SQL} GROUP BY ALL), days AS (SELECT source, d FROM v, LATERAL (SELECT unnest(generate_series(start_ts, end_ts, INTERVAL 1 DAY)) AS d) x)
SELECT v.source, sum(c)::BIGINT AS facts, count(*) AS intervals, round(100.0 * (sum(c) - count(*)) / sum(c), 3) AS repeated_interval_pct, CAST(median(c) AS DOUBLE) AS median_per_interval, max(c) AS max_per_interval, any_value(covered) AS covered_days
FROM v JOIN (SELECT source, count(DISTINCT d) AS covered FROM days GROUP BY source) USING (source) GROUP BY v.source""")
def text_intervals(spark, sf_dir):
    """Facts by their dated intervals, per source: how many share one, the median and most of one, and the days covered."""
    valid = raw_texts(spark, sf_dir).where(is_valid(F.col("fact"))).groupBy("source", "start_ts", "end_ts").agg(F.count("*").alias("c"))
    days = valid.select("source", F.explode(F.sequence("start_ts", "end_ts", F.expr("INTERVAL 1 DAY"))).alias("d")).groupBy("source").agg(F.countDistinct("d").alias("covered_days"))
    out = valid.groupBy("source").agg(F.sum("c").alias("facts"), F.count("*").alias("intervals"), F.round(100.0 * (F.sum("c") - F.count("*")) / F.sum("c"), 3).alias("repeated_interval_pct"), F.median("c").alias("median_per_interval"), F.max("c").alias("max_per_interval"))
    return out.join(days, "source")


@query(f"""WITH {PIT_SQL}, {"scaled AS" + LONG_SQL.split("scaled AS", 1)[1].replace("o AS (", "og AS (").replace("FROM o CROSS", "FROM og CROSS")}, o2 AS (SELECT DISTINCT domain, horizon, i FROM predictions)
SELECT o2.domain, o2.horizon, count(*) AS origins, round(100.0 * avg(CASE WHEN report_available + search_available > 0 THEN 1.0 ELSE 0.0 END), 6) AS covered_pct FROM o2 JOIN idx ON idx.domain = o2.domain AND idx.i = o2.i GROUP BY o2.domain, o2.horizon""")
def task_coverage(spark, sf_dir):
    """Text coverage of each task's own test origins, by a join of these with the text index."""
    origins = test_predictions(spark, sf_dir).select("domain", "horizon", "i").distinct()
    some = ((F.col("report_available") + F.col("search_available")) > 0).cast("double")
    return origins.join(index(spark, sf_dir), ["domain", "i"]).groupBy("domain", "horizon").agg(F.count("*").alias("origins"), F.round(100.0 * F.avg(some), 6).alias("covered_pct"))


#: Uniform draws by digest, as any engine computes them, of a kind, a series, an origin and a place in its window.
_UNIFORM = "(('0x' || substr(md5('{kind}|' || domain || '|' || i || '|' || p), 1, 8))::BIGINT + 0.5) / 4294967296"
CORRUPT_SQL = SCALED_SQL + f""", win AS (SELECT domain, i, n, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN {INPUT} PRECEDING AND 1 PRECEDING) AS x, z AS actual FROM scaled),
el AS (SELECT domain, i, p, actual, x[p + 1] AS v FROM win, range(0, {INPUT}) r(p) WHERE len(x) = {INPUT} AND i >= floor(n * 0.8::DOUBLE)),
dr AS (SELECT *, {_UNIFORM.format(kind="a")} AS ua, {_UNIFORM.format(kind="b")} AS ub, {_UNIFORM.format(kind="m")} AS um, {_UNIFORM.format(kind="s")} AS us FROM el),
co AS (SELECT domain, i, p, actual, u.kind, u.v FROM dr, LATERAL (VALUES ('clean', v), ('gaussian', v + 0.1 * sqrt(-2 * ln(ua)) * cos(2 * pi() * ub)), ('missing', CASE WHEN um < 0.1 THEN NULL ELSE v END), ('tail', CASE WHEN p >= {INPUT - 12} THEN NULL ELSE v END), ('spikes', v + CASE WHEN us < 0.01 THEN -3 WHEN us < 0.02 THEN 3 ELSE 0 END)) u(kind, v)),
fi AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY domain, i, kind ORDER BY p ROWS UNBOUNDED PRECEDING), 0.0) AS f FROM co)"""


@query(f"""WITH {CORRUPT_SQL}, m AS (SELECT domain, i, kind, avg((f)) AS mean, any_value(actual) AS actual FROM fi GROUP BY domain, i, kind), e AS (SELECT domain, kind, avg((mean - actual) ** 2) AS mse FROM m GROUP BY domain, kind)
SELECT domain, kind, round(mse, 6) AS mse, round(100 * (mse / max(CASE WHEN kind = 'clean' THEN mse END) OVER (PARTITION BY domain) - 1), 6) + 0.0 AS degradation_pct FROM e""")
def corruptions(spark, sf_dir):
    """The window's mean under four corruptions of its input, holes filled forward, against the clean input."""
    rows = S.windows(train_scaled(spark, sf_dir), INPUT, 1).where(F.col("i") >= int_frac(F.col("n"), 0.8))
    each = S.corrupted(rows, ["domain", "i"]).select("domain", "i", "kind", F.col("y")[0].alias("actual"), (F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / INPUT).alias("mean"))
    e = F.col("mean") - F.col("actual")
    scored = each.groupBy("domain", "kind").agg(F.avg(e * e).alias("mse"))
    clean = F.max(F.when(F.col("kind") == "clean", F.col("mse"))).over(S.W.partitionBy("domain"))
    return scored.select("domain", "kind", rounded("mse").alias("mse"), rounded(100 * (F.col("mse") / clean - 1)).alias("degradation_pct"))


RIDGE_SQL = SCALED_SQL + f""", win AS (SELECT domain, i, n, z AS y, lag(z) OVER (PARTITION BY domain ORDER BY i) AS a, avg(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN {INPUT} PRECEDING AND 1 PRECEDING) AS b FROM scaled),
rows_ AS (SELECT domain, y, a, b, CASE WHEN i + 1 <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i >= floor(n * 0.7::DOUBLE) AND i + 1 <= floor(n * 0.8::DOUBLE) THEN 'cal' WHEN i >= floor(n * 0.8::DOUBLE) THEN 'test' END AS segment FROM win WHERE i >= {INPUT}),
st AS (SELECT domain, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my FROM rows_ WHERE segment = 'train' GROUP BY domain),
z2 AS (SELECT domain, segment, (a - ma) / sa AS a, (b - mb) / sb AS b, y - my AS y FROM rows_ JOIN st USING (domain) WHERE segment IS NOT NULL),
gr AS (SELECT domain, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM z2 WHERE segment = 'train' GROUP BY domain),
w AS (SELECT domain, alpha, ((bb + alpha) * ay - ab * cy) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, ((aa + alpha) * cy - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM gr, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE), (1000.0::DOUBLE), (10000.0::DOUBLE)) t(alpha)),
sc AS (SELECT w.domain, alpha, avg((y - wa * a - wb * b) ** 2) FILTER (segment = 'cal') AS cal, avg((y - wa * a - wb * b) ** 2) FILTER (segment = 'test') AS test FROM w JOIN z2 USING (domain) GROUP BY w.domain, alpha)"""


@query(f"""WITH {RIDGE_SQL} SELECT domain, alpha, round(cal, 6) AS validation_mse, round(test, 6) AS test_mse FROM sc QUALIFY row_number() OVER (PARTITION BY domain ORDER BY round(cal, 9), alpha) = 1""")
def ridge_two_columns(spark, sf_dir):
    """Ridge on the last value and the window's mean, the penalty chosen on validation: two columns, which SQL can solve too."""
    series = train_scaled(spark, sf_dir)
    w = S.W.partitionBy("domain").orderBy("i")
    n, i = F.col("n"), F.col("i")
    rows = series.select("domain", "i", "n", F.array(F.lag("z").over(w), F.avg("z").over(w.rowsBetween(-INPUT, -1))).alias("x"), F.array("z").alias("y")).where(i >= INPUT)
    segment = S.segment(i, 1, [("train", F.lit(0), int_frac(n, 0.7)), ("cal", int_frac(n, 0.7), int_frac(n, 0.8)), ("test", int_frac(n, 0.8), n)])
    out = ridge.grid(rows.withColumn("segment", segment).where("segment is not null"), ["domain"])
    return out.select("domain", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))
