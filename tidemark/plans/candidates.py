"""Queries on ridge forecasters and text candidates. SQL can't solve these; tests hold them against direct solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import frequency_array, int_frac
from tidemark.operators import dual, lagged, permuted, residual, ridge, series as S, statistics as R, terms
from tidemark.plans import query
from tidemark.plans.series import rounded, train_scaled
from tidemark.plans.text import index, quality_features
from tidemark.sources.shared import settled
from tidemark.sources.tables import table

LENGTH, STEPS = 24, (3, 6)
#: Draws of the gate's null, draws of each of the four nulls of the widest candidate, and their seed.
DRAWS, WIDE_DRAWS, SEED = 999, 199, 1001


def task_windows(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    """Windows of every series and horizon with their segment of a 60/10/15/15 split; with text, its vector and quality.

    An origin's vector is that of its newest fact, by the fact's id; ids beyond the vectors start over, so all vectors are used.
    """
    n = F.col("n")
    cuts = [F.lit(0), *(int_frac(n, f) for f in (0.6, 0.7, 0.85)), n]
    rows = S.windows(train_scaled(spark, sf_dir), LENGTH, max(STEPS)).withColumn("horizon", F.explode(F.array(*map(F.lit, STEPS)))).withColumn("y", F.slice("y", F.lit(1), F.col("horizon")))
    names = ("train", "cal", "dec", "test")
    rows = rows.withColumn("segment", S.segment(F.col("i"), F.col("horizon"), list(zip(names, cuts, cuts[1:])))).where("segment is not null")
    middle = F.floor((cuts[2] + cuts[3]) / 2)
    half = F.when(F.col("segment") == "dec", F.when(F.col("i") + F.col("horizon") <= middle, 1).when(F.col("i") >= middle, 2))
    rows = rows.withColumn("half", half)
    if not with_text:
        return rows
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("e"))
    texts = index(spark, sf_dir).select("domain", "i", F.coalesce(F.get("search_ids", F.lit(0)), F.get("report_ids", F.lit(0))).cast("long").alias("fact"))
    known = vectors.count()
    texts = texts.select("domain", "i", F.pmod(F.coalesce("fact", F.col("i").cast("long")), F.lit(known)).alias("v"))
    quality = quality_features(spark, sf_dir)
    quality = quality.select("domain", "i", F.array(*quality.columns[2:]).alias("q"))
    rows = rows.join(texts.join(quality, ["domain", "i"]), ["domain", "i"]).join(vectors, "v").drop("v")
    return settled(rows.withColumn("f", frequency_array(F.col("x"), LENGTH)))


def candidates(windows: DataFrame, variants: tuple[str, ...] = tuple(residual.VARIANTS)) -> DataFrame:
    """Errors of each variant on the decision span and its halves, beside the last value's own."""
    out = residual.solved(windows, ["domain", "horizon"], {v: residual.VARIANTS[v] for v in variants})
    return out.withColumnRenamed("mode", "variant").drop("columns", "test_mse")


@query()
def attribution_modes(spark, sf_dir):
    """Errors of five sets of columns of one head, with and without statistics of the window: what each part adds.

    test_mse is that of a fit on training and calibration rows with the penalty chosen on calibration rows.
    """
    windows, out = task_windows(spark, sf_dir, True), None
    for head, modes in residual.MODES.items():
        some = residual.solved(windows, ["domain", "horizon"], modes, refit=True).withColumn("head", F.lit(head))
        out = some if out is None else out.unionByName(some)
    return out.select("domain", "horizon", "head", "mode", "columns", "alpha", *(rounded(c).alias(c) for c in ("calibration_mse", "mse", "fallback_mse", "test_mse")))


@query()
def ridge_baseline(spark, sf_dir):
    out = ridge.ar_ridge(task_windows(spark, sf_dir, False))
    return out.select("domain", "horizon", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))


@query()
def residual_candidates(spark, sf_dir):
    """Errors of ridge on what the last value leaves, for four sets of features, on the decision span and its halves."""
    out = candidates(task_windows(spark, sf_dir, True))
    return out.select("domain", "horizon", "variant", "alpha", *(rounded(c).alias(c) for c in out.columns[4:]))


@query()
def candidate_routes(spark, sf_dir):
    """Candidates, their permutation p-values and the gate's route per series and horizon."""
    windows = task_windows(spark, sf_dir, True)
    scores = candidates(windows, ("semantic",))
    keys = ["domain", "horizon"]
    p = R.empirical_p(permuted.null_scores(windows, keys, residual.VARIANTS["semantic"], DRAWS, SEED), keys)
    gated = R.gate(scores.join(p, keys), keys)
    routes = R.route(gated, keys, ["semantic"])
    return gated.select(*keys, "draws", rounded("p").alias("p"), rounded("mse").alias("mse")).join(routes, keys)


@query()
def circular_routes(spark, sf_dir):
    """p-values of the semantic candidate against 999 circular shifts of its text, by which a gate's finding is tried."""
    windows, keys = task_windows(spark, sf_dir, True), ["domain", "horizon"]
    scores = candidates(windows, ("semantic",))
    nulls = lagged.circular_null(windows, keys, scores.select(*keys, "alpha"), 999, max(STEPS), 1001)
    p = R.empirical_p(nulls.join(scores.select(*keys, F.col("mse").alias("aligned")), keys), keys)
    return p.join(scores, keys).select(*keys, "draws", rounded("p").alias("p"), rounded("mse").alias("mse"), (F.col("mse") < F.col("fallback_mse")).alias("better"))


@query()
def semantic_probe(spark, sf_dir):
    """Ridge of the target on every origin's own whole vector, alone and beside the window, and on vectors of other origins."""
    rows = task_windows(spark, sf_dir, True).where("segment != 'dec'").withColumn("segment", F.when(F.col("segment") == "cal", "val").otherwise(F.col("segment")))
    on = ["domain", "horizon", "segment"]
    moved = R.shuffled(rows.withColumn("text", F.struct("e", "q")), on, "i", "text", 202601)
    first = rows.groupBy(*on).agg(F.min("i").alias("first"))
    moved = moved.join(first, on).select(*on, (F.col("first") + F.col("at")).alias("i"), F.col("shuffled.e").alias("e"), F.col("shuffled.q").alias("q"))
    kept = rows.select(*on, "i", "x", "y")
    both = rows.select(*on, "i", "x", "y", "e", "q", F.lit("aligned").alias("alignment")).unionByName(kept.join(moved, [*on, "i"]).withColumn("alignment", F.lit("shuffled")))
    out = residual.probe(both, ["domain", "horizon", "alignment"], {"TextOnly": ("e", "q"), "EarlyFusion": ("x", "e", "q")}, ridge.ALPHAS)
    return out.select("domain", "horizon", "alignment", "kind", "columns", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))


@query()
def text_models(spark, sf_dir):
    """Ridge of the target on 1,024 terms of each origin's newest texts, alone and beside the window, and on other origins' texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", terms.plain("text").alias("words"))
    known = docs.count()
    newest = F.filter(F.array(F.get("search_ids", F.lit(0)), F.get("report_ids", F.lit(0))), lambda f: f.isNotNull())
    facts = index(spark, sf_dir).select("domain", "i", F.explode(F.array_distinct(newest)).alias("fact")).withColumn("fact", F.col("fact").cast("long"))
    texts = facts.join(docs, F.pmod("fact", F.lit(known)) == F.col("doc_id")).groupBy("domain", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact", "words"))), lambda f: f["words"]), " [sep] ").alias("text"))
    rows = task_windows(spark, sf_dir, False).where("segment != 'dec'").withColumn("segment", F.when(F.col("segment") == "cal", "val").otherwise(F.col("segment")))
    on = ["domain", "horizon", "segment"]
    rows = settled(rows.join(texts, ["domain", "i"], "left").select(*on, "i", "n", "x", "y", F.coalesce("text", F.lit("")).alias("text")))
    first = rows.groupBy(*on).agg(F.min("i").alias("first"))
    moved = R.shuffled(rows, on, "i", "text", 202602).join(first, on).select(*on, (F.col("first") + F.col("at")).alias("i"), F.col("shuffled").alias("text"))
    both = rows.withColumn("alignment", F.lit("aligned")).unionByName(rows.drop("text").join(moved, [*on, "i"]).withColumn("alignment", F.lit("shuffled")))
    out = terms.text_models(settled(both), ["domain", "horizon", "alignment"], ridge.ALPHAS)
    return out.select("domain", "horizon", "alignment", "kind", "terms", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))


@query()
def null_sensitivity(spark, sf_dir):
    """p-values of the frequency candidate under four nulls: rows or shifts moved, interaction scales kept or fitted anew."""
    windows, keys, out = task_windows(spark, sf_dir, True), ["domain", "horizon"], None
    for mode in ("row", "circular"):
        nulls = permuted.null_scores(windows, keys, residual.VARIANTS["frequency"], WIDE_DRAWS, SEED, mode, refits=(False, True))
        p = R.empirical_p(nulls, [*keys, "refit"]).select(*keys, F.lit(mode).alias("mode"), "refit", "draws", rounded("p").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


#: Features of the development study: the whole vector and its quality, without and with statistics of the window and their products.
DEVELOPMENT = {"numeric": ("x",), "no_frequency": ("x", "e", "q"), "full": ("x", "e", "q", "f", "cross")}
PLACEBOS = 3


@query()
def development_candidates(spark, sf_dir):
    """Ridge of the target itself on whole vectors, beside the mean of three fits on permuted texts: what a development gate takes in.

    The penalty is chosen on calibration rows, errors are those of the decision span and its halves; the fallback is the
    numeric fit's. A variant is chosen that beats it, the mean placebo, and the fallback in both halves.
    """
    windows, keys = task_windows(spark, sf_dir, True), ["domain", "horizon"]
    fits = residual.solved(windows, keys, DEVELOPMENT, most=16, residual=False).withColumnRenamed("mode", "variant")
    numeric = fits.where("variant = 'numeric'").select(*keys, F.col("mse").alias("fallback_mse"), F.col("mse_first").alias("fallback_first"), F.col("mse_second").alias("fallback_second"))
    placebo = None
    for variant in ("no_frequency", "full"):
        nulls = permuted.null_scores(windows, keys, DEVELOPMENT[variant], PLACEBOS, SEED, refits=(True,), residual=False, most=16)
        one = nulls.groupBy(*keys).agg(F.count("*").alias("placebos"), F.avg("null_score").alias("placebo_mse")).withColumn("variant", F.lit(variant))
        placebo = one if placebo is None else placebo.unionByName(one)
    rows = fits.select(*keys, "variant", "columns", "alpha", "mse", "mse_first", "mse_second").join(placebo, [*keys, "variant"]).join(numeric, keys)
    chosen = R.development_gate(rows, keys).select(*keys, F.col("variant").alias("chosen"))
    return rows.join(chosen, keys).select(*keys, "variant", "columns", "alpha", "placebos", *(rounded(c).alias(c) for c in ("mse", "placebo_mse", "fallback_mse")), "chosen")


@query()
def dual_semantic_probe(spark, sf_dir):
    """Ridge of the target on every origin's whole vector, solved in the space of rows."""
    rows = task_windows(spark, sf_dir, True).where("segment != 'dec'").select("domain", "horizon", "segment", "i", F.col("e").alias("x"), "y")
    out = dual.dual_grid(rows, ["domain", "horizon"])
    return out.select("domain", "horizon", "rows", "alpha", rounded("validation_mse").alias("validation_mse"), rounded("test_mse").alias("test_mse"))
