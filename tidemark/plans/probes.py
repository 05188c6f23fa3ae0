"""Linear probes on numbers and on texts, with shuffled controls and a permutation null, two columns each, which SQL can solve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import int_frac
from tidemark.operators import dual, lagged, permuted, residual, ridge, series as S, statistics as R, terms
from tidemark.plans import query
from tidemark.plans.series import INPUT, SCALED_SQL, rounded, train_scaled
from tidemark.plans.text import PIT_SQL, index
from tidemark.sources.shared import settled
from tidemark.sources.tables import table

SEED, DRAWS = 61, 999
_PLACE = "row_number() OVER (PARTITION BY domain, segment ORDER BY i)"
BASE_SQL = (
    PIT_SQL
    + ", "
    + "scaled AS"
    + SCALED_SQL.split("scaled AS", 1)[1]
    + f""", win AS (SELECT domain, i, n, z AS y, lag(z) OVER (PARTITION BY domain ORDER BY i) AS a, avg(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN {INPUT} PRECEDING AND 1 PRECEDING) AS b FROM scaled),
seg AS (SELECT w.domain, w.i, w.y - a AS y, a, b, ln(1 + report_available) AS c, ln(1 + search_available) AS d, CASE WHEN w.i + 1 <= floor(w.n * 0.6::DOUBLE) THEN 'train' WHEN w.i >= floor(w.n * 0.6::DOUBLE) AND w.i + 1 <= floor(w.n * 0.7::DOUBLE) THEN 'cal' WHEN w.i >= floor(w.n * 0.7::DOUBLE) AND w.i + 1 <= floor(w.n * 0.85::DOUBLE) THEN 'test' END AS segment
  FROM win w JOIN idx ON idx.domain = w.domain AND idx.i = w.i WHERE w.i >= {INPUT}),
pl AS (SELECT *, {_PLACE} AS p FROM seg WHERE segment IS NOT NULL)"""
)


def _solved(columns: str) -> str:
    """SQL of the two-column ridge grid over r2(keys, segment, y, a, b), the keys given."""
    on = ", ".join(columns.split())
    alphas = ", ".join(f"({a!r}::DOUBLE)" for a in ridge.ALPHAS)
    return f"""st AS (SELECT {on}, avg(a) AS ma, greatest(stddev_pop(a), CASE WHEN stddev_pop(a) < 1e-8 THEN 1 ELSE 0 END) AS sa, avg(b) AS mb, greatest(stddev_pop(b), CASE WHEN stddev_pop(b) < 1e-8 THEN 1 ELSE 0 END) AS sb, avg(y) AS my FROM r2 WHERE segment = 'train' GROUP BY {on}),
z2 AS (SELECT {on}, segment, (a - ma) / sa AS a, (b - mb) / sb AS b, y - my AS y, y AS raw FROM r2 JOIN st USING ({on})),
gr AS (SELECT {on}, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM z2 WHERE segment = 'train' GROUP BY {on}),
w2 AS (SELECT {on}, alpha, ((bb + alpha) * ay - ab * cy) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, ((aa + alpha) * cy - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM gr, (VALUES {alphas}) t(alpha)),
sc AS (SELECT {on}, alpha, avg((y - wa * a - wb * b) ** 2) FILTER (segment = 'cal') AS cal, avg((y - wa * a - wb * b) ** 2) FILTER (segment = 'test') AS mse, avg(raw * raw) FILTER (segment = 'test') AS plain FROM w2 JOIN z2 USING ({on}) GROUP BY {on}, alpha),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY {on} ORDER BY round(cal, 9), alpha) = 1)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per origin: its place in its segment, what the last value leaves of the next one (y), two numbers and two text columns."""
    n, i = F.col("n"), F.col("i")
    w = S.W.partitionBy("domain").orderBy("i")
    rows = train_scaled(spark, sf_dir).select("domain", "i", "n", "z", F.lag("z").over(w).alias("a"), F.avg("z").over(w.rowsBetween(-INPUT, -1)).alias("b")).where(i >= INPUT)
    segment = S.segment(i, 1, [("train", F.lit(0), int_frac(n, 0.6)), ("cal", int_frac(n, 0.6), int_frac(n, 0.7)), ("test", int_frac(n, 0.7), int_frac(n, 0.85))])
    texts = index(spark, sf_dir).select("domain", "i", F.array(F.log1p("report_available"), F.log1p("search_available")).alias("text"))
    rows = rows.withColumn("segment", segment).where("segment is not null").join(texts, ["domain", "i"])
    place = F.row_number().over(S.W.partitionBy("domain", "segment").orderBy("i"))
    return rows.select("domain", "segment", place.alias("p"), F.array(F.col("z") - F.col("a")).alias("y"), F.array("a", "b").alias("numbers"), "text")


def shuffled(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """rows for each draw with text of another row of the segment, in the order of a digest of draw, segment and place."""
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("draw").cast("string"), "segment", F.col("p").cast("string")).cast("binary"))
    moved = rows.join(F.broadcast(draws)).select("domain", "segment", "draw", "text", F.row_number().over(S.W.partitionBy("domain", "segment", "draw").orderBy(digest, "p")).alias("p"))
    return rows.drop("text").join(moved, ["domain", "segment", "p"])


def as_task(rows: DataFrame) -> DataFrame:
    """Rows of the probe as those of a task, whose features are the text's two columns and whose decision span is the test's."""
    none = F.array().cast("array<double>")
    n = F.count("*").over(S.W.partitionBy("domain")).cast("int")
    segment = F.when(F.col("segment") == "test", "dec").otherwise(F.col("segment"))
    return rows.select("domain", F.col("p").alias("i"), n.alias("n"), segment.alias("segment"), none.alias("x"), "y", none.alias("e"), F.col("text").alias("q"), none.alias("f"))


def fallback(rows: DataFrame) -> DataFrame:
    y = F.col("y")[0]
    return rows.where("segment = 'test'").groupBy("domain").agg(F.avg(y * y).alias("fallback_mse"))


@query(f"""WITH {BASE_SQL}, sh AS (SELECT domain, segment, row_number() OVER (PARTITION BY domain, segment ORDER BY md5('{SEED}|0|' || segment || '|' || p), p) AS p, c, d FROM pl),
r2 AS (SELECT domain, 'numeric' AS variant, segment, y, a, b FROM pl UNION ALL SELECT domain, 'text', segment, y, c, d FROM pl UNION ALL SELECT domain, 'shuffled', segment, y, sh.c, sh.d FROM pl JOIN sh USING (domain, segment, p)), {_solved("domain variant")}
SELECT domain, variant, alpha, round(cal, 6) AS calibration_mse, round(mse, 6) AS mse, round(plain, 6) AS fallback_mse, mse < plain AS better FROM best""")
def residual_probes(spark, sf_dir):
    """Ridge of what the last value leaves, on numbers alone, on texts alone, and on texts of other origins."""
    rows = placed(spark, sf_dir)
    one = shuffled(rows, spark.range(1).select(F.col("id").cast("int").alias("draw")))
    parts = [rows.select("domain", F.lit(v).alias("variant"), "segment", F.col(x).alias("x"), "y") for v, x in (("numeric", "numbers"), ("text", "text"))] + [one.select("domain", F.lit("shuffled").alias("variant"), "segment", F.col("text").alias("x"), "y")]
    out = ridge.grid(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["domain", "variant"]).join(fallback(rows), "domain")
    return out.select("domain", "variant", "alpha", rounded("validation_mse").alias("calibration_mse"), rounded("test_mse").alias("mse"), rounded("fallback_mse").alias("fallback_mse"), (F.col("test_mse") < F.col("fallback_mse")).alias("better"))


@query(f"""WITH {BASE_SQL}, dr AS (SELECT unnest(range(0, {DRAWS + 1})) AS draw), sh AS (SELECT domain, segment, draw, row_number() OVER (PARTITION BY domain, segment, draw ORDER BY CASE WHEN draw = 0 THEN '' ELSE md5('{SEED}|' || draw || '|' || CASE segment WHEN 'test' THEN 'dec' ELSE segment END || '|' || p) END, p) AS p, c, d FROM pl, dr),
r2 AS (SELECT domain, draw, segment, y, sh.c AS a, sh.d AS b FROM pl JOIN sh USING (domain, segment, p)), {_solved("domain draw")}, al AS (SELECT domain, mse AS aligned, plain AS fallback FROM best WHERE draw = 0)
SELECT domain, count(*) AS draws, round((1 + count(*) FILTER (round(mse, 9) <= round(aligned, 9))) / (count(*) + 1), 6) AS p, round(any_value(aligned), 6) AS mse, any_value(aligned) < any_value(fallback) AND (1 + count(*) FILTER (round(mse, 9) <= round(aligned, 9))) / (count(*) + 1) <= 0.025 AS eligible FROM best JOIN al USING (domain) WHERE draw > 0 GROUP BY domain""")
def probe_permutation_null(spark, sf_dir):
    """p of the text probe against its texts permuted within every segment, the penalty chosen anew for each draw."""
    rows = settled(as_task(placed(spark, sf_dir)))
    scores = permuted.null_scores(rows, ["domain"], ("q",), DRAWS, SEED, "digest", residual=False).withColumns({c: F.round(c, 9) for c in ("null_score", "aligned")})
    y = F.col("y")[0]
    plain = rows.where("segment = 'dec'").groupBy("domain").agg(F.avg(y * y).alias("fallback_mse"))
    p = R.empirical_p(scores, ["domain"]).join(scores.groupBy("domain").agg(F.first("aligned").alias("aligned")), "domain").join(plain, "domain")
    return p.select("domain", "draws", F.round("p", 6).alias("p"), rounded("aligned").alias("mse"), ((F.col("aligned") < F.col("fallback_mse")) & (F.col("p") <= 0.025)).alias("eligible"))


@query(f"""WITH {BASE_SQL}, r2 AS (SELECT domain, segment, y, c AS a, d AS b FROM pl), {_solved("domain")}
SELECT best.domain, n AS rows, alpha, round(cal, 6) AS validation_mse, round(mse, 6) AS test_mse FROM best JOIN (SELECT domain, CAST(count(*) AS INT) AS n FROM pl GROUP BY domain) USING (domain)""")
def dual_text_probe(spark, sf_dir):
    """The text probe solved in the space of rows: the same errors as from sums of products of its two columns."""
    rows = placed(spark, sf_dir)
    train = rows.where("segment = 'train'").groupBy("domain").agg(*(f(F.col("text")[k]).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    x = F.array(*((F.col("text")[k] - F.col(f"m{k}")) / F.when(F.col(f"s{k}") < 1e-8, 1.0).otherwise(F.col(f"s{k}")) for k in (0, 1)))
    out = dual.dual_grid(rows.join(train, "domain").select("domain", "segment", F.col("p").alias("i"), x.alias("x"), "y"), ["domain"])
    return out.select("domain", "rows", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))


SHIFTS, GUARD = 999, 6
_LOW = f"least(greatest(1, {GUARD}), n - 1)"
_LOW = f"CASE WHEN n - {_LOW} < {_LOW} THEN 1 ELSE {_LOW} END"


@query(f"""WITH {BASE_SQL}, r2 AS (SELECT domain, segment, y, c AS a, d AS b, p FROM pl), {_solved("domain")},
zs AS (SELECT domain, r2.segment, p, (a - ma) / sa AS a, (b - mb) / sb AS b, y - my AS y FROM r2 JOIN st USING (domain) WHERE r2.segment IN ('train', 'test')),
nn AS (SELECT domain, segment, count(*) AS n FROM zs GROUP BY domain, segment), lo AS (SELECT *, {_LOW} AS low FROM nn),
sh AS (SELECT domain, segment, n, draw, low + ('0x' || substr(md5('{SEED}|' || draw || '|' || CASE segment WHEN 'test' THEN 'dec' ELSE segment END), 1, 8))::BIGINT % greatest(n - 2 * low + 1, 1) AS s FROM lo, (SELECT unnest(range(1, {SHIFTS + 1})) AS draw)),
mv AS (SELECT z.domain, z.segment, draw, z.y, t.a, t.b FROM zs z JOIN sh ON sh.domain = z.domain AND sh.segment = z.segment JOIN zs t ON t.domain = z.domain AND t.segment = z.segment AND t.p = (z.p - 1 - s + n) % n + 1),
g AS (SELECT domain, draw, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM mv WHERE segment = 'train' GROUP BY domain, draw),
w AS (SELECT domain, draw, alpha, mse, ((bb + alpha) * ay - ab * cy) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, ((aa + alpha) * cy - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM g JOIN best USING (domain)),
e AS (SELECT domain, draw, any_value(alpha) AS alpha, any_value(mse) AS aligned, avg((y - wa * a - wb * b) ** 2) AS score FROM mv JOIN w USING (domain, draw) WHERE segment = 'test' GROUP BY domain, draw)
SELECT domain, count(*) AS draws, any_value(alpha) AS alpha, round((1 + count(*) FILTER (round(score, 9) <= round(aligned, 9))) / (count(*) + 1), 6) AS p, round(avg(score), 6) AS mean_null, round(any_value(aligned), 6) AS mse FROM e GROUP BY domain""")
def circular_probe_null(spark, sf_dir):
    """p of the text probe against 999 circular shifts of its texts, the penalty and the scales staying those of the aligned one."""
    rows = placed(spark, sf_dir)
    aligned = ridge.grid(rows.select("domain", "segment", F.col("text").alias("x"), "y"), ["domain"])
    none = F.array().cast("array<double>")
    moving = rows.where("segment != 'cal'").select("domain", F.col("p").alias("i"), F.when(F.col("segment") == "test", "dec").otherwise(F.col("segment")).alias("segment"), none.alias("x"), "y", none.alias("e"), F.col("text").alias("q"))
    nulls = lagged.circular_null(moving, ["domain"], aligned.select("domain", "alpha"), SHIFTS, GUARD, SEED).withColumn("null_score", F.round("null_score", 9))
    scores = nulls.join(aligned.select("domain", "alpha", F.round("test_mse", 9).alias("aligned")), "domain")
    p = R.empirical_p(scores, ["domain"]).join(scores.groupBy("domain").agg(F.avg("null_score").alias("mean_null"), F.first("alpha").alias("alpha"), F.first("aligned").alias("aligned")), "domain")
    return p.select("domain", "draws", "alpha", F.round("p", 6).alias("p"), rounded("mean_null").alias("mean_null"), rounded("aligned").alias("mse"))


@query(f"""WITH {BASE_SQL}, pm AS (SELECT domain, avg(c) AS mc, avg(d) AS md, 0.5 * atan2(2 * covar_pop(c, d), var_pop(c) - var_pop(d)) AS t, avg(a) AS ma, stddev_pop(a) AS sa, avg(y) AS my FROM pl WHERE segment = 'train' GROUP BY domain),
f1 AS (SELECT domain, segment, y - my AS y, y AS raw, CASE WHEN abs(cos(t)) >= abs(sin(t)) OR sin(t) > 0 THEN 1 ELSE -1 END * (cos(t) * (c - mc) + sin(t) * (d - md)) AS a, (pl.a - ma) / sa AS f FROM pl JOIN pm USING (domain)),
cs AS (SELECT domain, avg(a * f) AS mx, stddev_pop(a * f) AS sx FROM f1 WHERE segment = 'train' GROUP BY domain), z2 AS (SELECT domain, segment, y, raw, a, (a * f - mx) / sx AS b FROM f1 JOIN cs USING (domain)),
{_solved("domain").split("gr AS", 1)[1].join(("gr AS", ""))}
SELECT domain, 2 AS columns, alpha, round(cal, 6) AS calibration_mse, round(mse, 6) AS mse, round(plain, 6) AS fallback_mse FROM best""")
def component_candidates(spark, sf_dir):
    """The residual candidate of one principal component of the texts' columns and its product with the last value."""
    rows = placed(spark, sf_dir)
    n = rows.groupBy("domain").agg(F.count("*").cast("int").alias("n"))
    zero, none = F.array(F.lit(0.0)), F.array().cast("array<double>")
    segment = F.when(F.col("segment") == "test", "dec").otherwise(F.col("segment"))
    rows = rows.join(n, "domain").select("domain", F.col("p").alias("i"), "n", segment.alias("segment"), F.lit(None).cast("int").alias("half"), zero.alias("x"), "y", F.col("text").alias("e"), none.alias("q"), F.slice("numbers", 1, 1).alias("f"))
    out = residual.solved(rows, ["domain"], {"components": ("pca", "cross")}, most=1, crossed=1)
    return out.select("domain", "columns", "alpha", *(rounded(c).alias(c) for c in ("calibration_mse", "mse", "fallback_mse")))


_SCOPES = "(VALUES ('one', 'train'), ('both', 'train'), ('both', 'cal')) v(which, segment)"


@query(f"""WITH {BASE_SQL}, txt AS (SELECT pl.domain, pl.segment, pl.p, pl.y, regexp_extract_all(lower(translate(text, 'áéíóúñäöüàèçêÉÁÍÓÚÑÄÖÜÀÈÇÊ', 'aeiounaouaeceEAIOUNAOUAECE')), '[a-z0-9]{{2,}}') AS t FROM pl JOIN documents ON doc_id = pl.p % (SELECT count(*) FROM documents)),
tw AS (SELECT domain, segment, p, unnest(list_concat(t, list_transform(range(1, len(t)), lambda k: t[k] || ' ' || t[k + 1]))) AS term FROM txt), tf AS (SELECT domain, segment, p, term, count(*) AS c FROM tw GROUP BY ALL),
voc AS (SELECT which, domain, term, count(*) AS df, row_number() OVER (PARTITION BY which, domain ORDER BY sum(c) DESC, term) AS k FROM tf JOIN {_SCOPES} USING (segment) GROUP BY which, domain, term HAVING count(*) >= 2 QUALIFY k <= 2),
nn AS (SELECT which, domain, count(*) AS n FROM txt JOIN {_SCOPES} USING (segment) GROUP BY which, domain),
wt AS (SELECT which, domain, segment, p, k, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN voc USING (domain, term) JOIN nn USING (which, domain)),
un AS (SELECT which, domain, segment, p, coalesce(sum(x) FILTER (k = 1), 0) / sqrt(sum(x * x)) AS a, coalesce(sum(x) FILTER (k = 2), 0) / sqrt(sum(x * x)) AS b FROM wt GROUP BY ALL),
vec AS (SELECT s.which, t.domain, t.segment, t.p, t.y, coalesce(a, 0) AS a, coalesce(b, 0) AS b, v.segment IS NOT NULL AS fits FROM txt t CROSS JOIN (VALUES ('one'), ('both')) s(which) LEFT JOIN un ON un.which = s.which AND un.domain = t.domain AND un.segment = t.segment AND un.p = t.p LEFT JOIN {_SCOPES} ON v.which = s.which AND v.segment = t.segment),
st AS (SELECT which, domain, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM vec WHERE fits GROUP BY which, domain), z AS (SELECT which, domain, segment, fits, a - ma AS a, b - mb AS b, y - my AS y FROM vec JOIN st USING (which, domain)),
gr AS (SELECT which, domain, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM z WHERE fits GROUP BY which, domain),
w AS (SELECT which, domain, alpha, ((bb + alpha) * ay - ab * cy) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, ((aa + alpha) * cy - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM gr, (VALUES {", ".join(f"({a!r}::DOUBLE)" for a in ridge.ALPHAS)}) t(alpha)),
e AS (SELECT which, domain, alpha, avg((y - wa * a - wb * b) ** 2) FILTER (segment = 'cal') AS cal, avg((y - wa * a - wb * b) ** 2) FILTER (segment = 'test') AS test FROM z JOIN w USING (which, domain) GROUP BY ALL),
best AS (SELECT domain, alpha, cal FROM e WHERE which = 'one' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY round(cal, 9), alpha) = 1)
SELECT domain, 2 AS terms, alpha, round(best.cal, 6) AS validation_mse, round(test, 6) AS test_mse FROM best JOIN e USING (domain, alpha) WHERE which = 'both'""")
def two_term_probe(spark, sf_dir):
    """Ridge on the weights of two terms of each origin's document; vocabularies are those of the rows that a fit has."""
    rows = placed(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", terms.plain("text").alias("words"))
    known = docs.count()
    n = rows.groupBy("domain").agg(F.count("*").cast("int").alias("n"))
    rows = rows.join(n, "domain").join(docs, F.col("p") % known == F.col("doc_id"))
    segment = F.when(F.col("segment") == "cal", "val").otherwise(F.col("segment"))
    rows = settled(rows.select("domain", F.col("p").alias("i"), "n", segment.alias("segment"), F.col("numbers").alias("x"), "y", F.col("words").alias("text")))
    out = terms.text_models(rows, ["domain"], ridge.ALPHAS, most=2).where("kind = 'TextOnly'")
    return out.select("domain", "terms", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))
