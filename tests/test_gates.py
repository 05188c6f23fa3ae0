"""Gates over errors that tie exactly: held against fractions in plain Python and against the queries' own SQL."""

import hashlib
import random
from fractions import Fraction

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries


def split(total, count, most, seed):
    """So many whole numbers from 0 to most with this total, in a seeded order."""
    draw, values = random.Random(seed), [total // count] * count
    for k in range(total % count):
        values[k] += 1
    for _ in range(4 * count):
        a, b = draw.sample(range(count), 2)
        if values[a] > 0 and values[b] < most:
            values[a], values[b] = values[a] - 1, values[b] + 1
    draw.shuffle(values)
    return values


def lines():
    """(task, line, discount, tax) in hundredths: equal variants, errors equal to the fallback's, to the placebo's, in both halves or one."""
    out = []
    for task in range(160):
        n = 10 + 10 * (task % 3)
        d, t = ((5 * n, 6 * n), (5 * n, 4 * n), (37 * n // 10, 3 * n), (4 * n, 5 * n), (6 * n, 6 * n))[task // 8 % 5]
        for span, at in enumerate((1, 4, 6)):
            size = n if span else n * (1 + task % 2)
            grow = size // n
            out += [(task, at + k % 2, a, b) for k, (a, b) in enumerate(zip(split(d * grow, size, 10, 3 * task + span), split(t * grow, size, 8, 1000 + 3 * task + span)))]
    random.Random(7).shuffle(out)
    return out


#: Stand for values that are not finite.
ODD = {-1: "NaN", -2: "Infinity", -3: "-Infinity"}


def table(folder, rows):
    """The folder with rows as its lineitem, ODD values as what they stand for."""
    frame = pd.DataFrame(rows, columns=["l_suppkey", "l_linenumber", "d", "t"]).astype({"l_suppkey": "Int64", "l_linenumber": "Int32", "d": "Int64", "t": "Int64"})  # noqa: F841  DuckDB reads it by its name
    value = lambda c: f"CASE {c} {' '.join(f"WHEN {k} THEN '{v}'::DOUBLE" for k, v in ODD.items())} ELSE {c} / 100 END"
    duckdb.connect().sql(f"COPY (SELECT l_suppkey, l_linenumber, {value('d')} AS l_discount, {value('t')} AS l_tax FROM frame) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


def answers(spark, sf_dir, name):
    """The rows of a query, after comparing them with those of its SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf_dir}/lineitem.parquet')")
    want = con.sql(oracle_sql()[name])
    got = [tuple(r) for r in queries()[name](spark, sf_dir).select(*want.columns).collect()]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)
    return [dict(zip(want.columns, r)) for r in got]


def errors(rows):
    """Per task and variant (error, fallback) of the whole span and of both halves, as fractions; None where there is no mean."""
    groups, exact = {}, lambda v: None if v is None else Fraction(v, 100)
    odd = {task for task, _, *values in rows if set(values) & set(ODD)}
    for task, line, d, t in rows:
        groups.setdefault(task, []).append((line, exact(d), exact(t)))

    def mean(values):
        known = [v for v in values if v is not None]
        return sum(known) / len(known) if known else None

    out = {}
    for task, some in groups.items():
        for variant, weight, plus in (("semantic", Fraction(80, 100), 0), ("frequency", Fraction(79, 100), Fraction(5, 10000))):
            spans = [[r for r in some if keep(r[0])] for keep in (lambda k: True, lambda k: k <= 3, lambda k: k > 5)]
            out[task, variant] = [(mean([d if d is None else d * weight + plus for _, d, _ in s]), mean([t for _, _, t in s])) for s in spans]
            if task in odd:
                out[task, variant][0] = (None, None)
    return out


@pytest.fixture(scope="module")
def ties(tmp_path_factory):
    rows = lines()
    return table(tmp_path_factory.mktemp("ties"), rows), errors(rows)


def test_development_gate_decides_exact_ties(spark, ties):
    sf_dir, found = ties
    want = {}
    for task in {task for task, _ in found}:
        chosen = []
        for variant in ("semantic", "frequency"):
            (mse, fallback), *halves = found[task, variant]
            if mse < fallback and mse < fallback * Fraction(101, 100) - Fraction(task % 8, 10000) and all(a < b for a, b in halves):
                chosen.append((mse, variant))
        want[task] = (len(chosen), min(chosen)[1] if chosen else "numeric")
    assert {r["task"]: (r["chosen"], r["variant"]) for r in answers(spark, sf_dir, "development_gate")} == want
    assert {n for n, _ in want.values()} == {0, 1, 2}


def routes(found):
    """Per task (eligible variants, route) by the gate's rule, in fractions."""
    out = {}
    for task in {task for task, _ in found}:
        eligible = []
        for place, variant in enumerate(("semantic", "frequency")):
            spans = found[task, variant]
            if task is not None and Fraction(task % 8, 200) <= Fraction(25, 1000) and all(None not in pair and pair[0] < pair[1] for pair in spans):
                eligible.append((spans[0][0], place, variant))
        out[task] = (len(eligible), min(eligible)[2] if eligible else "numeric_fallback")
    return out


def seals(decided):
    """Per hundred tasks (number of decisions, their seal)."""
    parts = {}
    for task in sorted(decided, key=lambda t: (t is not None, t)):
        parts.setdefault(None if task is None else task // 100, []).append(f"{'' if task is None else task}={decided[task][1]}")
    return {part: (len(some), hashlib.sha256(";".join(some).encode()).hexdigest()) for part, some in parts.items()}


def test_frozen_decisions_seal_exact_ties(spark, ties):
    sf_dir, found = ties
    assert {r["part"]: (r["decisions"], r["seal"]) for r in answers(spark, sf_dir, "frozen_decisions")} == seals(routes(found))


def test_frozen_decisions_seal_every_task(spark, tmp_path):
    """Tasks without a number and below 0 are in a part of their own, and in its seal."""
    rows = [(task, line, 5, 6) for task in (None, -8, 8, -104, 104) for line in (1, 4, 6)]
    got = {r["part"]: (r["decisions"], r["seal"]) for r in answers(spark, table(tmp_path, rows), "frozen_decisions")}
    assert got == seals(routes(errors(rows)))
    assert set(got) == {None, -1, 0, -2, 1}


def replayed(decided):
    """Per task (route, stored) where the stored decision differs."""
    stored = {task: "semantic" if task is not None and task % 10 == 3 else None if task is not None and task % 10 == 7 else route for task, (_, route) in decided.items()}
    return {task: (route, stored[task]) for task, (_, route) in decided.items() if route != stored[task]}


def test_gate_replay_decides_exact_ties(spark, ties):
    sf_dir, found = ties
    assert {r["task"]: (r["route"], r["stored"]) for r in answers(spark, sf_dir, "gate_replay")} == replayed(routes(found))


def test_gate_replay_of_a_task_without_number(spark, tmp_path):
    """Its stored decision was not altered, so it doesn't differ."""
    rows = [(task, line, 5, 6) for task in (None, 1, 7, 23) for line in (1, 4, 6)]
    got = {r["task"]: (r["route"], r["stored"]) for r in answers(spark, table(tmp_path, rows), "gate_replay")}
    assert got == replayed(routes(errors(rows))) == {7: ("numeric_fallback", None), 23: ("numeric_fallback", "semantic")}


def test_gate_route_decides_exact_ties(spark, ties):
    sf_dir, found = ties
    want = routes(found)
    assert {r["task"]: (r["eligible"], r["route"]) for r in answers(spark, sf_dir, "gate_route")} == want
    assert {r for _, r in want.values()} == {"semantic", "frequency", "numeric_fallback"}


def test_gate_route_of_unknown_and_odd_values(spark, tmp_path):
    """Means are over the known values, of which discounts and taxes may have different numbers; odd values leave no error."""
    rows = [(task, line, 5, 6) for task in range(6) for line in (1, 4, 6)] + [(task, 4, None, 2) for task in (0, 8)]
    rows += [(1, 4, -1, 6), (2, 4, 5, -2), (3, 4, -3, 6), (4, 4, 5, -1), (4, 6, None, None)]
    rows += [(8, 1, 5, 4), (8, 6, 5, 6)] + [(16, line, d, 4) for line in (1, 6) for d in (5, None, None)] + [(24, line, None, 6) for line in (1, 6)] + [(None, 1, 5, 6)]
    got = {r["task"]: (r["eligible"], r["route"]) for r in answers(spark, table(tmp_path, rows), "gate_route")}
    assert got == routes(errors(rows))
    assert {task for task, (n, _) in got.items() if n} == {0, 5}


def test_gate_route_of_great_values(spark, tmp_path):
    """Sums that no long holds are exact: a difference of 0.02 counts beside 24 trillions, and equal sums tie."""
    t = 10**14
    spans = {0: [(5 * t, 4 * t)], 1: [(900 * 10**12, 900 * 10**12)], 2: [(-900 * 10**12, -700 * 10**12)], 3: [(5, 10**14)], 4: [(10**14, 6)]}
    rows = [(task, line, d, x) for task, some in spans.items() for d, x in some for line in (1, 6) for _ in range(3)]
    rows += [(5, line, 5 * t, 4 * t) for line in (1, 6) for _ in range(3)] + [(5, line, 5, 6) for line in (1, 6)]
    got = {r["task"]: (r["eligible"], r["route"]) for r in answers(spark, table(tmp_path, rows), "gate_route")}
    assert got == routes(errors(rows))
    assert got == {0: (1, "frequency"), 1: (2, "frequency"), 2: (2, "semantic"), 3: (2, "semantic"), 4: (0, "numeric_fallback"), 5: (2, "frequency")}


@pytest.mark.parametrize("value", [(10**15, 6), (-(10**15), 6), (5, 10**15)])
def test_gate_route_refuses_values_beyond_a_long(spark, tmp_path, value):
    """A value of ten trillions has no exact units in a long: the query fails as its SQL does, and doesn't cut it to the greatest long."""
    sf_dir = table(tmp_path, [(task, line, 5, 6) for task in range(6) for line in (1, 4, 6)] + [(0, 4, *value)])
    with pytest.raises(duckdb.Error, match="out of range"):
        duckdb.connect().sql(oracle_sql()["gate_route"].replace("FROM lineitem", f"FROM read_parquet('{sf_dir}/lineitem.parquet')")).fetchall()
    with pytest.raises(Exception, match="too great"):
        queries()["gate_route"](spark, sf_dir).collect()
