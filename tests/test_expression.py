from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidegrid import catalogs
from tidegrid.plans.expression import ExpressionError, Interner, evaluate, plan


def test_catalog_sizes():
    assert len(catalogs.alpha101()) == 101
    assert len(catalogs.alpha158()) == 158
    assert len(catalogs.alpha360()) == 360
    assert len(catalogs.price_volume()) == 18 + 60 + 9
    assert sum(map(len, catalogs.fundamentals().values())) == 53
    assert len(catalogs.styles()) + len(catalogs.report_styles()) + 1 == 18


def test_equal_parts_are_one_node():
    i = Interner()
    assert i.parse("ts_mean(close, 5) + 1") is i.parse("ts_mean(close, 5) + 1")
    assert i.parse("ts_mean(close, 2 + 3)") is i.parse("ts_mean(close, 5)")


@given(st.floats(0.5, 50), st.floats(0.5, 50))
def test_constants_fold(a, b):
    n = Interner().parse(f"{a!r} * {b!r} + 1")
    assert n.op == "const" and n.value == a * b + 1


def test_both_spellings_are_the_same():
    i = Interner()
    assert i.parse("If($close < Ref($open, 1) || $volume == 0, CSRank($close), -1 * Abs($open))") is i.parse("choose(close < delay(open, 1) or volume == 0, rank(close), -1 * abs(open))")
    assert i.parse("rank(close) if open < close else 0") is i.parse("If($open < $close, CSRank($close), 0)")
    assert i.parse("Ref($close, 0)") is i.parse("close")


@pytest.mark.parametrize("text", ["close <", "close < open", "nothing(close, 2)", "ts_mean(close)", "ts_mean(close, 2.5)", "ts_mean(close, 0)", "ts_mean(close, open)", "choose(close, 1, 2)", "rank(close < open)", "close != open", "'text'", "missing_field + 1"])
def test_what_has_no_meaning(text):
    with pytest.raises(ExpressionError):
        Interner({"close", "open"}).parse(text)


def test_alternations_are_those_of_the_deepest():
    one = plan({"a": "rank(ts_mean(rank(close), 5))"}).alternations
    both = plan({"a": "rank(ts_mean(rank(close), 5))", "b": "ts_sum(ts_mean(close, 3), 4)", "c": "rank(open)"}).alternations
    assert one == 3 and both <= 4


def rows(spark):
    close = {1: [1.0, 2.0, None, 4.0, 8.0], 2: [5.0, 5.0, 5.0, 5.0, 5.0], 3: [9.0, 7.0, 7.0, 3.0, 1.0]}
    data = [(f"2024-01-0{t}", s, t, v, "a" if s < 3 else "b") for s, vs in close.items() for t, v in enumerate(vs, 1)]
    df = spark.createDataFrame(data, "date string, symbol long, t long, close double, industry string")
    return df.withColumn("date", df.date.cast("date"))


def test_closed_forms(spark):
    out = evaluate(rows(spark), {"lag": "delay(close, 1)", "mean": "ts_mean(close, 3)", "rank": "rank(close)", "low": "ts_argmin(close, 3)", "wma": "decay(close, 2)", "last": "ts_rank(close, 3)", "ind": "neutralize(close, industry)", "corr": "corr(close, close, 3)", "none": "close / (close - close)", "n": "ts_count(close, 3)"})
    got = {(r.symbol, r.t): r for r in out.collect()}
    assert got[1, 1].lag is None and got[1, 2].lag == 1.0 and got[1, 4].lag is None
    assert got[1, 2]["mean"] is None and got[1, 3]["mean"] == 1.5 and got[1, 5]["mean"] == 6.0
    assert got[1, 1]["rank"] == 0.0 and got[2, 1]["rank"] == 0.5 and got[1, 3]["rank"] is None and got[2, 3]["rank"] == 0.0
    assert got[2, 4].low == 1.0 and got[3, 5].low == 3.0 and got[1, 5].low == 2.0
    assert got[1, 2].wma == pytest.approx(5 / 3) and got[1, 4].wma == 4.0
    assert got[2, 3]["last"] == pytest.approx(2 / 3) and got[1, 3]["last"] is None and got[1, 5]["last"] == 1.0
    assert got[1, 1].ind == -2.0 and got[2, 1].ind == 2.0 and got[3, 1].ind == 0.0
    assert got[2, 3].corr is None and got[3, 4].corr == pytest.approx(1.0)
    assert got[1, 1].none is None and got[1, 3].n == 2.0


def test_nothing_looks_ahead(spark):
    whole = rows(spark)
    text = {k: v for k, v in list(catalogs.alpha158().items())[:20] if "vwap" not in v and "open" not in v and "high" not in v and "low" not in v} | {"x": "rank(ts_mean(rank(close), 2)) - decay(close, 3)"}
    cut = {(r.symbol, r.t): r.asDict() for r in evaluate(whole.filter("t <= 3"), text).collect()}
    for r in evaluate(whole, text).filter("t <= 3").collect():
        assert r.asDict() == cut[r.symbol, r.t]
