import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import formula as fm
from pulsegrid.functions import numeric as N

LONG = [
    "a - (b * (c + 4) / 3) + [d / (e + 0.25), f * f].max - {g * g - [h, -i].min} / 7",
    "+".join(f"({x} * {n} - {n}) / ({x} + {n})" for n, x in enumerate("abcdefghij", 1)),
    "[" * 6 + "a" + "".join(f", {x} * 0.{n}].{'max' if n % 2 else 'min'}" for n, x in enumerate("bcdefg", 3)),
]
INF, NAN = math.inf, math.nan


def div(a, b):
    try:
        return a / b
    except ZeroDivisionError:
        return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1, b)


def evaluate(node, env):
    if isinstance(node, fm.Number):
        return node.value
    if isinstance(node, fm.Name):
        return env[node.text]
    a = [evaluate(x, env) for x in node.args]
    big = lambda x, y: (not math.isnan(y)) and (math.isnan(x) or x > y)
    return {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: div(*a), "neg": lambda: -a[0],
            "max": lambda: a[0] if big(*a) else a[1], "min": lambda: a[0] if big(a[1], a[0]) else a[1]}[node.op]()


def values(spark, text, rows, names="abc"):
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return [r[0] for r in df.select(fm.compile_formula(text).cast("double")).collect()]


def same(x, y):
    return x == y or (x is not None and y is not None and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-12)))


def test_precedence_and_grouping(spark):
    cases = {"a+b*c": 7.0, "(a+b)*c": 9.0, "a-b-c": -4.0, "c**b**b": 81.0, "-a*b": -2.0, "a*-b": -2.0, "{a+[b]}*c": 9.0, "c//b": 1.0, "b^c": 1.0, "b&c": 2.0, "a|b": 3.0, "a+b&c": 3.0,
             "(a>b)?a:c": 3.0, "a<b?a:c": 1.0, "((a<b)?b:c)*c": 6.0, "a=a?b:c": 2.0, "a>=b?a:b": 2.0, "a!=b?7:8": 7.0, "[a,b].max": 2.0, "[a,b].min": 1.0, "a[0]+b[1]": 3.0, ".5+1e-1*c": 0.8}
    for text, want in cases.items():
        assert same(values(spark, text, [(1.0, 2.0, 3.0)])[0], want), text


def test_division_on_odd_numbers(spark):
    grid = [0.0, -0.0, 1.0, -1.0, 3.5, INF, -INF, NAN]
    rows = [(a, b, 0.0) for a in grid for b in grid]
    assert all(same(x, div(a, b)) for x, (a, b, _) in zip(values(spark, "a/b", rows), rows))
    assert values(spark, "a/b", [(None, 1.0, 0.0), (1.0, None, 0.0)]) == [None, None]
    got = values(spark, "a//b", [(7.0, 2.0, 0.0), (-7.0, 2.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)])
    assert got[:3] == [3.0, -4.0, INF] and math.isnan(got[3])


def test_max_min_bits_with_null_and_nan(spark):
    rows = [(1.0, None, 0.0), (None, 1.0, 0.0), (1.0, NAN, 0.0)]
    high, low = values(spark, "[a,b].max", rows), values(spark, "[a,b].min", rows)
    assert high[:2] == [None, None] and math.isnan(high[2]) and low == [None, None, 1.0]
    assert values(spark, "a & b", [(NAN, 3.0, 0.0), (-1.0, 3.0, 0.0)]) == [0.0, 3.0]


@pytest.mark.parametrize("text", ["", "a+", "(a", "a)", "[a,b]", "[a,b].sum", "a b", "a ? b", "a[b]", "[a,b,c].max", "a # b"])
def test_errors(text):
    with pytest.raises(fm.FormulaError):
        fm.parse(text)


def test_long_formulas(spark):
    for text in LONG:
        assert fm.names(fm.parse(text)) <= set("abcdefghij")
        env = {n: float(i + 2) for i, n in enumerate("abcdefghij")}
        got = values(spark, text, [tuple(env.values())], "abcdefghij")[0]
        assert same(got, evaluate(fm.parse(text), env))


leaf = st.sampled_from(["a", "b", "c", "2", "0.5"])
texts = st.recursive(leaf, lambda x: st.one_of(st.tuples(x, st.sampled_from("+-*/"), x).map(lambda t: f"({t[0]}){t[1]}({t[2]})"), st.tuples(x, x, st.sampled_from(["max", "min"])).map(lambda t: f"[{t[0]},{t[1]}].{t[2]}")), max_leaves=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=5, max_size=5))
def test_random_formulas(spark, some):
    rows = [(1.0, 0.0, -3.0), (2.5, -1.0, 0.0), (NAN, 1.0, INF)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select(*(fm.compile_formula(t).cast("double").alias(f"f{i}") for i, t in enumerate(some))).collect()
    for row, r in zip(got, rows):
        for x, t in zip(row, some):
            assert same(x, evaluate(fm.parse(t), dict(zip("abc", r)))), (t, r, x)


def test_statistics_helpers(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (3.0,)], "v double")
    v = F.col("v")
    assert all(map(same, df.agg(N.nan_min(v), N.nan_max(v), N.p95(v)).first(), (1.0, 3.0, 2.9)))
    assert df.where("v = 1").agg(N.variation(v)).first()[0] == 0.0 and df.where("v > 9 and v < 0").agg(N.variation(v)).first()[0] is None
