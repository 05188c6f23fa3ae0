"""Known answers and invariants of the operators."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tests import direct
from tidemark.operators import dual, forecast, lagged, moments, permuted, pit, residual, ridge, series, statistics, terms
from tidemark.sources import sealed, sinks, tables

DAY = datetime(2020, 1, 1)


def dates(spark, n, domain="a"):
    return spark.createDataFrame([(domain, DAY + timedelta(days=k), float(k)) for k in range(n)], "domain string, start_ts timestamp, ot double")


def test_point_in_time_boundary(spark):
    facts = spark.createDataFrame([(k, "a", "report", DAY + timedelta(days=k), t) for k, t in enumerate(("past", "now", "later"))], "fact_id long, domain string, source string, end_ts timestamp, fact string")
    origins = pit.origins(series.with_positions(dates(spark, 3)), 1)
    index = {r["i"]: r for r in pit.text_index(origins, facts, fact_id="fact_id").collect()}
    assert index[1]["report_ids"] == ["0"]  # a fact that ends at the origin isn't known yet, one at history's start is
    assert index[2]["report_ids"] == ["1"]
    assert index[1]["search_ids"] == [] and index[1]["search_available"] == 0


def test_bucketed_join_equals_plain_range_join(spark):
    facts = spark.createDataFrame([(k, "ab"[k % 2], "report", DAY + timedelta(hours=7 * k)) for k in range(60)], "fact_id long, domain string, source string, end_ts timestamp")
    origins = pit.origins(series.with_positions(dates(spark, 20).unionByName(dates(spark, 15, "b"))), 3)
    got = pit.eligible(origins, facts, 36000).groupBy("domain", "i", "fact_id").count()
    want = origins.join(facts, "domain").where("end_ts >= history_start and end_ts < cutoff").groupBy("domain", "i", "fact_id").count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 50


def test_origins_without_facts_stay(spark):
    facts = spark.createDataFrame([], "fact_id long, domain string, source string, end_ts timestamp, fact string")
    out = pit.text_index(pit.origins(series.with_positions(dates(spark, 5)), 2), facts, fact_id="fact_id").collect()
    assert len(out) == 3 and all(r["latest_age"] is None and r["report_selected"] == 0 for r in out)


def test_text_functions(spark):
    cases = [(None, False), ("", False), ("  ", False), ("NA", False), ("na - x", False), ("NAME", True), ("NA - x\nmore", True), (" NA", False), ("fine", True)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(text.is_valid(F.col("t"))).collect()] == [v for _, v in cases]
    words = spark.createDataFrame([("It WILL rain",), ("forecasts",), ("projected",), (None,)], "t string")
    assert [r[0] for r in words.select(text.tells_future(F.col("t"))).collect()] == [True, False, True, False]
    assert spark.range(1).select(text.normalise(F.lit(" a \n b "))).first()[0] == "a b"


@pytest.mark.parametrize("n", [10, 57, 110, 1999])
def test_int_frac_is_binary(spark, n):
    assert spark.range(1).select(numbers.int_frac(F.lit(n), 0.7)).first()[0] == int(n * 0.7)


def test_half_masks_known_answers(spark):
    rows = spark.createDataFrame([(i, 12, 216, 247) for i in range(216, 236)] + [(i, 24, 890, 1017) for i in range(890, 994)], "i int, horizon int, train_end int, validation_end int")
    out = {r["horizon"]: r for r in series.half_masks(rows).groupBy("horizon").agg(*(F.count_if(c).alias(c) for c in ("calibration", "decision", "first_half", "second_half"))).collect()}
    assert (out[12]["calibration"], out[12]["decision"], out[12]["first_half"], out[12]["second_half"]) == (4, 5, 0, 0)
    assert out[24]["first_half"] > 0 and out[24]["second_half"] > 0


def test_forecasters(spark):
    df = spark.createDataFrame([([float(k) for k in range(12)],)], "x array<double>")
    last, season = df.select(forecast.persistence(F.col("x"), 3), forecast.seasonal_naive(F.col("x"), 5, 3)).first()
    assert last == [11.0] * 3 and season == [9.0, 10.0, 11.0, 9.0, 10.0]


def test_filling_and_trimming(spark):
    values = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([("a", k, 6, v) for k, v in enumerate(values)], "domain string, i int, n int, ot double")
    assert [r[0] for r in series.filled(df, F.lit(6)).orderBy("i").select("filled").collect()] == [2.5, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert [r["i"] for r in series.trimmed(df).orderBy("i").collect()] == [1, 2, 3, 4]
    out = spark.createDataFrame([([None, 2.0, None],)], "x array<double>").select(numbers.ffill_array(F.col("x"))).first()[0]
    assert out == [0.0, 2.0, 2.0]


def test_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(tables.finite(F.col("v"))).collect()] == [None, None, None, 1.5, None]
    assert spark.createDataFrame([("x",), ("2",), ("NaN",)], "v string").select(tables.coerce(F.col("v"))).collect()[1][0] == 2.0


def test_frequency_statistics_match_numpy(spark):
    x = np.random.default_rng(3).normal(size=(5, 8))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, x array<double>")
    cols = numbers.frequency_statistics(F.col("x"), numbers.spectrum(F.col("x"), 8), 5)
    got = np.array([tuple(r) for r in df.orderBy("k").select(*cols.values()).collect()])
    assert np.allclose(got, direct.frequencies(x), atol=1e-9)


def test_holm_and_bh_known_answer(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,)], "p double")
    out = statistics.holm_bh(df).orderBy("p").collect()
    assert [round(r["holm"], 6) for r in out] == [0.03, 0.04, 0.04] and [round(r["bh"], 6) for r in out] == [0.03, 0.03, 0.03]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from([0.001, 0.01, 0.02, 0.2, 0.5, 1.0]), min_size=1, max_size=8))
def test_adjusted_p_values_are_monotone(spark, ps):
    out = statistics.holm_bh(spark.createDataFrame([(p,) for p in ps], "p double")).orderBy("p").collect()
    for name in ("holm", "bh"):
        v = [r[name] for r in out]
        assert v == sorted(v) and all(r[name] >= r["p"] - 1e-12 for r in out) and max(v) <= 1


def test_block_bootstrap_of_a_constant(spark):
    df = spark.createDataFrame([("a", k, 0.5) for k in range(30)], "g string, i long, d double")
    r = statistics.block_bootstrap(df, ["g"], 7, 50, 1).first()
    assert (r["n"], r["mean"]) == (30, 0.5) and abs(r["low"] - 0.5) < 1e-9 and abs(r["high"] - 0.5) < 1e-9


def test_few_blocks_have_no_effect_size(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(11)], "g string, i long, d double")
    assert statistics.block_power(df, ["g"], 5).first()["mde"] is None


def test_gate_needs_both_halves(spark):
    df = spark.createDataFrame([("t", "semantic", 0.5, 1.0, 0.4, 0.9, None, None, 0.01), ("u", "semantic", 0.5, 1.0, 0.4, 0.9, 0.1, 0.2, 0.01)], "task string, variant string, mse double, fallback_mse double, mse_first double, fallback_first double, mse_second double, fallback_second double, p double")
    routes = {r["task"]: r["route"] for r in statistics.route(statistics.gate(df, ["task"]), ["task"], ["semantic"]).collect()}
    assert routes == {"t": "numeric_fallback", "u": "semantic"}


def test_disagreement_gate(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0, 0.1), ("a", 0.0, 0.0, 5.0), ("a", 0.2, 0.0, 0.2), ("a", 0.0, 0.0, 6.0)], "g string, actual double, numeric double, candidate double")
    r = statistics.disagreement_gate(points, ["g"]).first()
    assert r["threshold"] < 5 and r["mse"] <= 0.01


def test_ridge_matches_a_direct_solve():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 4)), rng.normal(size=(40, 2))
    (w, c), = direct.solve(x, y, (10.0,))
    a = np.hstack([x, np.ones((40, 1))])
    plain = np.linalg.solve(a.T @ a + 10.0 * np.diag([1, 1, 1, 1, 0]), a.T @ y)
    assert np.allclose(np.vstack([w, c]), plain)


def test_components_are_centred():
    x = np.random.default_rng(1).normal(3, 1, size=(30, 6))
    assert np.allclose(direct.Components(x)(x).mean(axis=0), 0) and direct.Components(x[:3])(x).shape[1] == 2


def test_weighted_mean_has_length_one(spark):
    df = spark.createDataFrame([("a", [3.0, 0.0], 1.0), ("a", [0.0, 4.0], 1.0), ("b", [0.0, 0.0], 1.0)], "k string, embedding array<double>, w double")
    out = {r["k"]: r["mean"] for r in pit.weighted_mean(df, ["k"]).collect()}
    assert np.allclose(out["a"], [0.6, 0.8]) and out["b"] == [0.0, 0.0]


def test_csv_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "Climate"
    folder.mkdir()
    (folder / "Climate.csv").write_text("date,OT,x\n2020-01-02,2,oops\n2020-01-01,,5\n")
    (folder / "Climate_report.csv").write_text('start_date,end_date,fact,preds\n2020-01-01,2020-01-02,"a, b",never\n')
    got = tables.read_series_csv(spark, str(folder / "Climate.csv")).orderBy("file_row").collect()
    assert [(r["domain"], r["ot"], r["channels"]["x"]) for r in got] == [("Climate", 2.0, None), ("Climate", None, 5.0)]
    facts = tables.read_text_csv(spark, str(folder / "Climate_report.csv"))
    assert (facts.first()["source"], facts.first()["fact"], "preds" in facts.columns) == ("report", "a, b", False)
    assert len(tables.file_digests(spark, str(folder)).first()["sha256"]) == 64
    sinks.write_csv(facts, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["fact"] == "a, b"
    task = spark.createDataFrame([("a", 3, 1.0)], "domain string, horizon int, v double")
    sinks.write_evidence(task, str(tmp_path / "ev"))
    sinks.write_evidence(spark.createDataFrame([("b", 3, 2.0)], "domain string, horizon int, v double"), str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_record(spark, {"x": float("nan")}, str(tmp_path / "rec"))


def test_streamed_hours_match_batch(spark):
    from tidemark.streaming import hourly

    stream = hourly.hourly(hourly.event_stream(spark, "/root/testdata/sf0.001"), "1 hour")
    query = stream.writeStream.outputMode("append").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    batch = tables.hourly_series(spark, "/root/testdata/sf0.001")
    got = spark.sql("select domain, start_ts, ot from hours")
    assert got.count() > 800 and got.exceptAll(batch.select("domain", "start_ts", "ot")).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_dual_grid_equals_the_primal(spark, block):
    rng = np.random.default_rng(4)
    rows = [("ab"[k], s, i, rng.normal(size=60).tolist(), rng.normal(size=2).tolist()) for k in range(2) for s, n in (("train", 40), ("cal", 9), ("test", 7), ("dec", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "domain string, segment string, i int, x array<double>, y array<double>").repartition(5)
    got = {r["domain"]: r for r in dual.dual_grid(df, ["domain"], block=block).collect()}
    for d in "ab":
        part = {s: tuple(np.array([r[k] for r in rows if r[:2] == (d, s)], float) for k in (3, 4)) for s in ("train", "cal", "test")}
        alpha, score, (w, c) = direct.best_fit(part["train"], part["cal"])
        assert got[d]["rows"] == 56 and got[d]["alpha"] == alpha
        assert np.allclose([got[d]["validation_mse"], got[d]["test_mse"]], [score, direct.mse(part["test"][1], part["test"][0] @ w + c)])
    with pytest.raises(Exception, match="takes 50"):
        dual.dual_grid(df, ["domain"], limit=50).collect()
    assert dual.dual_grid(df.where("segment != 'cal'"), ["domain"]).count() == 0 and dual.dual_grid(df.where("false"), ["domain"]).count() == 0


def test_rotation_is_a_shift_that_moves_rows():
    for n in (4, 20, 101):
        order = ridge.rotated(n, np.random.default_rng(n), 4)
        assert sorted(order) == list(range(n)) and len({(a - b) % n for a, b in zip(order, range(n))}) == 1 and order[0] != 0


def task_rows(seed=2, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        e, x = rng.normal(size=3), rng.normal(size=4)
        segment, half = ("train", None) if i < 80 else ("cal", None) if i < 110 else ("dec", 1 if i < 128 else None if i < 130 else 2) if i < 145 else ("test", None)
        rows.append(("a", 1, i, n, segment, half, x.tolist(), [float(x[-1] + e[0]), float(x[-1] + e[1] * x[0])], e.tolist(), rng.normal(size=2).tolist(), direct.frequencies(x[None])[0].tolist()))
    return rows


TASK = "domain string, horizon int, i int, n int, segment string, half int, x array<double>, y array<double>, e array<double>, q array<double>, f array<double>"


def part_of(rows, *segments):
    some = [r for r in rows if r[4] in segments]
    return {c: np.array([r[k] for r in some], float) for k, c in ((6, "x"), (7, "y"), (8, "e"), (9, "q"))} | {"half": np.array([r[5] or 0 for r in some])}


def rest(part):
    return part["y"] - part["x"][:, -1:]


@pytest.mark.parametrize("chunk", [16384, 7])
def test_candidates_from_sums_equal_direct_fits(spark, monkeypatch, chunk):
    monkeypatch.setattr(moments.chunked_gram, "__defaults__", (chunk,))
    rows = task_rows()
    train, cal, dec = (part_of(rows, s) for s in ("train", "cal", "dec"))
    df = spark.createDataFrame(rows, TASK).repartition(5)
    got = {r["mode"]: r for r in residual.solved(df, ["domain", "horizon"], residual.VARIANTS).collect()}
    assert set(got) == {"numeric", "semantic", "frequency", "fourier"} and got["semantic"]["mse"] < 0.8 * got["numeric"]["mse"]
    for variant, r in got.items():
        build = direct.Builder(variant, train)
        alpha, score, (w, c) = direct.best_fit((build(train), rest(train)), (build(cal), rest(cal)))
        error = ((rest(dec) - build(dec) @ w - c) ** 2).mean(axis=1)
        assert r["alpha"] == alpha and r["columns"] == build(dec).shape[1]
        want = [score, error.mean(), error[dec["half"] == 1].mean(), error[dec["half"] == 2].mean(), (rest(dec) ** 2).mean()]
        assert np.allclose([r[k] for k in ("calibration_mse", "mse", "mse_first", "mse_second", "fallback_mse")], want)
    few = spark.createDataFrame([r for r in rows if r[4] != "cal"], TASK)
    assert residual.solved(few, ["domain", "horizon"], residual.VARIANTS).count() == 0 and residual.solved(df.where("false"), ["domain"], residual.VARIANTS).count() == 0


def test_attribution_modes_are_choices_of_columns(spark):
    rows = task_rows()
    train, cal, test = (part_of(rows, s) for s in ("train", "cal", "test"))
    df = spark.createDataFrame(rows, TASK)
    for modes in residual.MODES.values():
        got = {r["mode"]: r for r in residual.solved(df, ["domain"], modes, refit=True).collect()}
        assert set(got) == set(modes) and got["full"]["columns"] == got["dimension_matched_numeric"]["columns"]
    build = direct.Builder("semantic", train)
    alpha, _, _ = direct.best_fit((build(train), rest(train)), (build(cal), rest(cal)))
    got = {r["mode"]: r for r in residual.solved(df, ["domain"], residual.MODES["semantic"], refit=True).collect()}["full"]
    both = np.vstack((build(train), build(cal))), np.vstack((rest(train), rest(cal)))
    (w, c), = direct.solve(*both, (alpha,))
    assert got["alpha"] == alpha and np.isclose(got["test_mse"], direct.mse(rest(test), build(test) @ w + c))


def test_probe_on_vectors_equals_direct_fits(spark):
    rows = [(*r[:4], {"cal": "val", "dec": "none"}.get(r[4], r[4]), *r[5:]) for r in task_rows()]
    train, val, test = (part_of(rows, s) for s in ("train", "val", "test"))
    got = {r["kind"]: r for r in residual.probe(spark.createDataFrame(rows, TASK), ["domain"], {"TextOnly": ("e", "q"), "EarlyFusion": ("x", "e", "q")}, ridge.ALPHAS).collect()}
    both = {c: np.concatenate((train[c], val[c])) for c in train}
    for kind, parts in (("TextOnly", "eq"), ("EarlyFusion", "xeq")):
        def design(d, by):
            return np.hstack([direct.Scale(by["q"])(d["q"]) if c == "q" else d[c] for c in parts])
        alpha, score, _ = direct.best_fit((design(train, train), train["y"]), (design(val, train), val["y"]))
        (w, c), = direct.solve(design(both, both), both["y"], (alpha,))
        assert got[kind]["alpha"] == alpha and np.allclose([got[kind]["validation_mse"], got[kind]["test_mse"]], [score, direct.mse(test["y"], design(test, both) @ w + c)])


def test_circular_null_equals_direct_fits(spark):
    rows = task_rows(n=145)
    df = spark.createDataFrame(rows, TASK).repartition(4)
    alphas = spark.createDataFrame([("a", 3.0)], "domain string, alpha double")
    got = {r["draw"]: r["null_score"] for r in lagged.circular_null(df, ["domain"], alphas, 20, 5, 77, most=2).collect()}
    parts = {s: part_of(rows, s) for s in ("train", "dec")}
    sizes = spark.createDataFrame([(s, len(p["x"])) for s, p in parts.items()], "segment string, n int")
    shifts = {r["segment"]: r["shifts"] for r in lagged.drawn_shifts(sizes, 5, 20, 77).collect()}
    assert all(5 <= k <= len(parts[s]["x"]) - 5 for s, v in shifts.items() for k in v) and len(set(shifts["train"])) > 10
    build = direct.Builder("semantic", parts["train"])
    build.e = direct.Components(parts["train"]["e"], 2)
    for d in range(20):
        moved = {s: p | {c: np.roll(p[c], shifts[s][d], axis=0) for c in "eq"} for s, p in parts.items()}
        (w, c), = direct.solve(build(moved["train"]), rest(moved["train"]), (3.0,))
        assert np.isclose(got[d + 1], direct.mse(rest(moved["dec"]), build(moved["dec"]) @ w + c))
    tiny = spark.createDataFrame([("a", s, n) for s, n in (("train", 2), ("dec", 3))], "domain string, segment string, n int")
    assert {r["segment"]: set(r["shifts"]) for r in lagged.drawn_shifts(tiny, 24, 50, 1).collect()} == {"train": {1}, "dec": {1, 2}}


def null_by_fits(rows, parts, draw, refit, orders, residual_y=True):
    """The score of a draw by features made anew and direct fits."""
    train, cal, dec = (part_of(rows, s) for s in ("train", "cal", "dec"))
    moved = [d | {c: d[c][orders[s]] for c in "eq"} for s, d in (("train", train), ("cal", cal), ("dec", dec))]
    build = direct.Builder("frequency" if "cross" in parts else "semantic", moved[0] if refit else train)
    _, _, (w, c) = direct.best_fit((build(moved[0]), rest(train)), (build(moved[1]), rest(cal)))
    return direct.mse(rest(dec), build(moved[2]) @ w + c)


@pytest.mark.parametrize("variant", ["semantic", "frequency"])
def test_permuted_scores_equal_direct_fits(spark, variant):
    rows = task_rows()
    parts = residual.VARIANTS[variant]
    df = spark.createDataFrame(rows, TASK).repartition(5)
    got = permuted.null_scores(df, ["domain", "horizon"], parts, 7, 1001, refits=(False, True), chunk=3).collect()
    assert sorted((r["refit"], r["draw"]) for r in got) == [(f, d) for f in (False, True) for d in range(1, 8)]
    counts = {s: len(part_of(rows, s)["x"]) for s in permuted.SEGMENTS}
    for r in got:
        orders = permuted.by_generator(1001, r["draw"], 0, counts)
        assert np.isclose(r["null_score"], null_by_fits(rows, parts, r["draw"], r["refit"], orders))
    aligned = {r["mode"]: r["mse"] for r in residual.solved(df, ["domain", "horizon"], {variant: parts}).collect()}[variant]
    assert all(np.isclose(r["aligned"], aligned) for r in got) and (variant != "semantic" or min(r["null_score"] for r in got) > aligned)


@pytest.mark.parametrize("mode", ["row", "circular"])
def test_long_series_are_permuted_in_strata(spark, monkeypatch, mode):
    """Sums over strata equal those of one task that moves the same rows; every row keeps to its stratum."""
    rows = task_rows()
    df = spark.createDataFrame(rows, TASK).repartition(5)
    parts = residual.VARIANTS["frequency"]
    monkeypatch.setattr(permuted, "by_generator", lambda seed, draw, stratum, counts: {s: np.arange(n)[::-1] if draw > 1 else np.arange(n) for s, n in counts.items()})
    got = permuted.null_scores(df, ["domain"], parts, 4, 5, mode, refits=(False, True), guard=2, stratum_rows=40, chunk=2).collect()
    assert sorted((r["refit"], r["draw"]) for r in got) == [(f, d) for f in (False, True) for d in range(1, 5)]
    aligned = residual.solved(df, ["domain"], {"frequency": parts}).first()["mse"]
    assert all(np.isclose(r["aligned"], aligned) for r in got)
    if mode == "row":
        strata = {r["i"]: r["s"] for r in df.select("i", F.pmod(F.xxhash64("i"), F.lit(4)).cast("int").alias("s")).collect()}
        orders = {}
        for segment in permuted.SEGMENTS:
            places = [r[2] for r in rows if r[4] == segment]
            orders[segment] = np.arange(len(places))
            for s in range(4):
                at = np.array([k for k, i in enumerate(places) if strata[i] == s], int)
                orders[segment][at] = at[::-1]
        for r in got:
            want = null_by_fits(rows, parts, r["draw"], r["refit"], orders) if r["draw"] > 1 else aligned
            assert np.isclose(r["null_score"], want)
    else:
        assert all(r["alpha"] == got[0]["alpha"] for r in got) and len({round(r["null_score"], 9) for r in got}) > 3


def test_nulls_of_short_and_empty_series(spark):
    rows = task_rows()
    few = spark.createDataFrame([r for r in rows if r[4] != "cal"], TASK)
    for some in (few, few.where("false")):
        for stratum in (40, 65536):
            assert permuted.null_scores(some, ["domain"], residual.VARIANTS["semantic"], 3, 1, stratum_rows=stratum).count() == 0
    with pytest.raises(ValueError, match="no such mode"):
        permuted.null_scores(few, ["domain"], ("x",), 3, 1, "other")


def test_a_test_waits_for_its_seal(spark, tmp_path):
    path, rows = str(tmp_path / "d"), spark.createDataFrame([("a", 6, "Last", 0.5), ("b", 6, None, None)], "domain string, horizon int, model string, mse double")
    with pytest.raises(ValueError, match="no sealed decisions"):
        sealed.open_frozen(spark, path)
    rows.write.parquet(f"{path}/decisions")
    with pytest.raises(ValueError, match="no sealed decisions"):
        sealed.open_frozen(spark, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sealed.freeze(rows, path)
    path = str(tmp_path / "e")
    sealed.freeze(rows, path)
    assert sorted(map(str, sealed.open_frozen(spark, path).collect())) == sorted(map(str, rows.collect()))
    rows.write.parquet(str(tmp_path / "results"))
    assert sealed.evidence_order(spark, path, str(tmp_path / "results")).first()["in_order"]
    assert not sealed.evidence_order(spark, str(tmp_path / "results"), path).first()["in_order"]
    rows.replace("Last", "Mean", "model").write.mode("overwrite").parquet(f"{path}/decisions")
    with pytest.raises(ValueError, match="not those that were sealed"):
        sealed.open_frozen(spark, path)


def test_lists_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b, c"]), (2, [])], "i int, ids array<string>")
    sinks.write_csv(df, str(tmp_path / "lists"))
    back = tables.read_lists(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "lists")), "ids")
    assert {(r["i"], tuple(r["ids"])) for r in back.collect()} == {("1", ("a", "b, c")), ("2", ())}
    (tmp_path / "s.json").write_text('{"domains": {"A": {"input_len": 24, "horizons": [1, 30], "seasonal_period": 12}}}')
    grid = tables.task_grid(tables.read_settings(spark, str(tmp_path / "s.json")), 3).collect()
    assert {(r["horizon"], r["fold"], r["block"]) for r in grid} == {(h, f, b) for h, b in ((1, 12), (30, 30)) for f in (1, 2, 3)}


def test_files_with_headers_of_their_own(spark, tmp_path):
    for name, text in {"A": "date,OT,temp\n2020-01-02,2,5\n2020-01-01,x,\n", "B": "humidity,start_date,end_date,OT,date\n1,2021-01-01,2021-01-03,7,9\n", "C": "Month,OT\n2022-01-01,1\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csv").write_text(text)
    got = {(r["domain"], str(r["start_ts"])[:10]): (str(r["end_ts"])[:10], r["ot"], r["channels"]) for r in tables.read_series_csv(spark, f"{tmp_path}/*/*.csv").collect()}
    assert got == {
        ("A", "2020-01-02"): ("2020-01-02", 2.0, {"temp": 5.0}), ("A", "2020-01-01"): ("2020-01-01", None, {"temp": None}),
        ("B", "2021-01-01"): ("2021-01-03", 7.0, {"humidity": 1.0, "date": 9.0}), ("C", "2022-01-01"): ("2022-01-01", 1.0, {}),
    }
    rows = tables.read_untyped_csv(spark, f"{tmp_path}/A/*.csv").orderBy("file_row").collect()
    assert [r["cells"] for r in rows] == [{"date": "2020-01-02", "OT": "2", "temp": "5"}, {"date": "2020-01-01", "OT": "x", "temp": None}]


def test_a_broken_rule_fails_the_job(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    assert series.demand(df, {"no key": F.col("k") > 0}).count() == 2
    with pytest.raises(Exception, match="no value"):
        series.demand(df, {"no key": F.col("k") > 0, "no value": F.col("v").isNotNull()}).collect()


def test_empty_columns_go(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, `b.c` double, d string")
    assert series.drop_empty_columns(df).columns == ["a", "d"]


def test_gram_grid_matches_rows(spark):
    rng = np.random.default_rng(3)
    x, y, seg = rng.normal(size=(200, 5)), rng.normal(size=(200, 2)), ["train"] * 120 + ["cal"] * 40 + ["test"] * 40
    y += x[:, :2]
    df = spark.createDataFrame([("g", s, a.tolist(), b.tolist()) for s, a, b in zip(seg, x, y)], "g string, segment string, x array<double>, y array<double>")
    got = ridge.grid(df, ["g"]).first()
    part = lambda s: (x[np.array(seg) == s], y[np.array(seg) == s])
    scale = direct.Scale(part("train")[0])
    alpha, score, (w, c) = direct.best_fit((scale(part("train")[0]), part("train")[1]), (scale(part("cal")[0]), part("cal")[1]))
    assert got["alpha"] == alpha and abs(got["validation_mse"] - score) < 1e-9 and abs(got["test_mse"] - direct.mse(part("test")[1], scale(part("test")[0]) @ w + c)) < 1e-9


def test_places_in_buckets_are_those_of_one_window(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 2], int(rng.integers(0, 50)), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, k int")
    got = {(r["g"], r["k"]): r["at"] for r in series.ordinal(df, ["g"], F.floor(F.col("t") / 7), ["t", "k"], "at").collect()}
    for g in "ab":
        assert [got[g, k] for _, k in sorted((t, k) for h, t, k in rows if h == g)] == list(range(1, 151))


@pytest.mark.parametrize("most", [3, 1024])
def test_text_models_equal_direct_fits(spark, most):
    rng = np.random.default_rng(8)
    words = ["rise", "fall", "rate", "bank", "x1", "a", "Éclair"]
    rows = [("d", i, 90, "train" if i < 50 else "val" if i < 70 else "test", rng.normal(size=2).tolist(), [float(rng.normal())], " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(90)]
    rows[3] = (*rows[3][:6], None)
    schema = "domain string, i int, n int, segment string, x array<double>, y array<double>, text string"
    df = spark.createDataFrame(rows, schema).withColumn("text", terms.plain("text")).repartition(3)
    got = {r["kind"]: r for r in terms.text_models(df, ["domain"], ridge.ALPHAS, most=most).collect()}

    def texts(*segments):
        return [(r[6] or "").lower().replace("é", "e") for r in rows if r[3] in segments]

    def weighed(fit, some):
        df, total = Counter(), Counter()
        for t in fit:
            found = Counter(terms.terms_of(t))
            df.update(found.keys())
            total.update(found)
        known = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:most]
        out = np.zeros((len(some), len(known)))
        for k, t in enumerate(some):
            c = Counter(terms.terms_of(t))
            v = np.array([(1 + np.log(c[w])) * (np.log((1 + len(fit)) / (1 + df[w])) + 1) if c[w] else 0.0 for w in known])
            out[k] = v / (np.linalg.norm(v) or 1.0)
        return out

    numbers_of = lambda k, *segments: np.array([r[k] for r in rows if r[3] in segments])
    for kind in ("TextOnly", "EarlyFusion"):
        def design(fit, *segments):
            t = weighed(texts(*fit), texts(*segments))
            return t if kind == "TextOnly" else np.hstack((numbers_of(4, *segments), t))  # noqa: B023
        one, both = ("train",), ("train", "val")
        alpha, score, _ = direct.best_fit((design(one, "train"), numbers_of(5, "train")), (design(one, "val"), numbers_of(5, "val")))
        (w, c), = direct.solve(design(both, *both), numbers_of(5, *both), (alpha,))
        assert got[kind]["alpha"] == alpha and np.allclose([got[kind]["validation_mse"], got[kind]["test_mse"]], [score, direct.mse(numbers_of(5, "test"), design(both, "test") @ w + c)])


def test_vocabulary_is_that_of_all_terms(spark):
    rng = np.random.default_rng(9)
    rows = [(" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 30) % 60),) for _ in range(80)]
    df = spark.createDataFrame(rows, "text string")
    found, total = Counter(), Counter()
    for (t,) in rows:
        one = Counter(terms.terms_of(t))
        found.update(one.keys())
        total.update(one)
    want = [(t, found[t]) for t in sorted((t for t in found if found[t] >= 2), key=lambda t: (-total[t], t))]
    for most, words in ((5, 50_000), (40, 50_000), (40, 0), (5000, 50_000)):
        assert terms.vocabulary(df, most, words_at_most=words) == want[:most]
    assert terms.vocabulary(df.where("false")) == []
