"""Differential tests against pandas, on seeded data."""

import collections
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fanframe import errors, session
from fanframe.functions.batches import NULL, whole_groups
from fanframe.functions.frames import Frame
from fanframe.operators import apply, apply_cells, apply_columns, apply_rows, apply_values, expanding, group_apply, map_values, rolling
from fanframe.plans import catalog
from fanframe.progress import Progress


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(42)
    n = 300
    return pd.DataFrame({"id": range(n), "g": rng.integers(1, 5, n), "h": rng.integers(1, 3, n), "a": rng.integers(1, 8, n), "b": np.where(rng.random(n) < 0.1, np.nan, rng.random(n))})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(7)


def same(df, expected, key="id", column="result"):
    got = df.toPandas().sort_values(key, ignore_index=True)[column]
    pd.testing.assert_series_equal(got.astype(float), pd.Series(list(expected), dtype=float), check_names=False)


def test_rows(df, pdf):
    f = lambda r: math.sin(r["a"] ** 2) + r["b"]
    for partitions in (1, 2, 7):
        same(apply(df, f, axis=1, returns="double", keys=["id"], columns=["a", "b"], partitions=partitions), pdf.apply(f, axis=1))


def test_row_shapes(df, pdf):
    wide = apply_rows(df, lambda r: [r["a"], r["a"] * 2], "x double, y double", keys=["id"], columns=["a"]).toPandas().sort_values("id")
    assert (wide["y"] == 2 * wide["x"]).all() and len(wide) == len(pdf)
    lists = apply_rows(df, lambda r: [int(r["a"])], "array<long>", keys=["id"], columns=["a"]).toPandas()
    assert all(len(x) == 1 for x in lists["result"])


def test_axis_names(df):
    for axis in (2, "rows", None, True):
        with pytest.raises(ValueError):
            apply(df, max, axis=axis, returns="double")


def test_columns(df, pdf):
    got = apply_columns(df, lambda x: x.max() - x.min(), "double", columns=["a", "b"]).toPandas().set_index("column")["result"]
    assert got["a"] == pytest.approx(pdf["a"].max() - pdf["a"].min()) and got["b"] == pytest.approx(pdf["b"].max() - pdf["b"].min())
    kept = apply_columns(df, lambda x: x.cumsum(), "double", columns=["a"], order_by=["id"], mode="same")
    same(kept, pdf["a"].cumsum(), column="a")


def test_cells_and_values(df, pdf):
    same(apply_cells(df, lambda x: x * 2, "double", columns=["b"], keys=["id"]), pdf["b"] * 2, column="b")
    same(map_values(df, "a", {1: 10.0, 2: 20.0}, "double", keys=["id"]), pdf["a"].map({1: 10.0, 2: 20.0}))
    same(map_values(df, "a", {k: float(k) for k in range(2, 400)}, "double", keys=["id"]), pdf["a"].where(pdf["a"] > 1))
    same(map_values(df, "b", lambda x: 1.0, "double", keys=["id"], na_action="ignore"), pdf["b"].map(lambda x: 1.0, na_action="ignore"))
    same(apply_values(df, "a", lambda x, p, bias: x**p + bias, "double", keys=["id"], args=(2,), bias=3), pdf["a"] ** 2 + 3)


def test_mappings_with_a_default(df, pdf):
    table = collections.defaultdict(lambda: -1.0, {1: 10.0})
    same(map_values(df, "a", table, "double", keys=["id"]), pdf["a"].map(table))


def test_columns_without_rows(spark, df):
    none = df.filter("false")
    for f, native in ((lambda x: x.max() - x.min(), False), (lambda c: F.max(c) - F.min(c), True)):
        got = apply_columns(none, f, "double", columns=["a", "b"], native=native).toPandas()
        assert sorted(got["column"]) == ["a", "b"] and got["result"].isna().all()
    assert apply(spark.createDataFrame([], "a long").select(), max, axis=0, returns="double").count() == 0


def test_native_columns_and_windows_keep_to_many_tasks(df, pdf):
    moved = apply_columns(df, lambda c, over: c - over(F.avg(c)), columns=["a"], order_by=["id"], mode="same", native=True)
    same(moved, pdf["a"] - pdf["a"].mean(), column="a")
    for how in FRAMES[::3]:
        if how["min_periods"] != 0:
            got = rolling(df, "b", order_by=["id"], **how).apply(lambda c, w: F.sum(c).over(w), native=True, chunk_rows=40)
            same(got, pdf["b"].rolling(**how).sum())
            assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_native_windows_that_would_differ_are_refused(spark, df):
    timed = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01"]), "v": [1.0]}))
    with pytest.raises(NotImplementedError):
        rolling(timed, "v", "6h", ["ts"]).apply(lambda c, w: F.sum(c).over(w), native=True)
    with pytest.raises(NotImplementedError):
        rolling(df, "b", 3, ["id"], min_periods=0).apply(lambda c, w: F.sum(c).over(w), native=True)


def test_groups_know_their_name(df):
    got = group_apply(df, "g", lambda x: x.name, "long", columns=["a"]).toPandas()
    assert (got["g"] == got["result"]).all()
    both = group_apply(df, ["g", "h"], lambda x: x.name[0] * 10 + x.name[1], "long", columns=["a"]).toPandas()
    assert (both["g"] * 10 + both["h"] == both["result"]).all()


def test_bars_for_all_stages(spark, df, capsys):
    session.initialize(spark, progress_bar=True)
    try:
        apply_values(df, "a", float, "double").collect()
        group_apply(df, "g", len, "long").collect()
        map_values(df, "a", {1: 2.0}, "double").collect()
        time.sleep(1)
    finally:
        session.initialize(spark)
    said = capsys.readouterr().err
    assert "300 rows done" in said and "4 groups done" in said


def test_groups(df, pdf):
    for keys in ("g", ["g"], ["g", "h"]):
        got = group_apply(df, keys, lambda x: x["a"].sum(), "double", columns=["a"]).toPandas().sort_values(keys if isinstance(keys, list) else [keys])
        assert got["result"].tolist() == pdf.groupby(keys)["a"].sum().tolist()
    moved = group_apply(df, "g", lambda x: x["a"] - x["a"].mean(), "double", mode="transform", order_by=["id"], columns=["a"])
    same(moved, pdf["a"] - pdf.groupby("g")["a"].transform("mean"))


def test_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, v double")
    assert group_apply(df, "k", len, "long").count() == 1
    assert group_apply(df, "k", len, "long", dropna=False).count() == 2
    assert group_apply(df.filter("false"), "k", len, "long").columns == ["k", "result"]
    assert rolling(df.filter("false"), "v", 3, ["v"], by="k").apply(np.sum, raw=True).count() == 0


FRAMES = [{"window": w, "min_periods": m, "center": c, "closed": e} for w in (4, 5) for m in (1, None) for c in (False, True) for e in (None, "left", "both", "neither")]


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_rolling_in_chunks(df, pdf, chunk):
    for how in FRAMES[:: 1 if chunk == 50 else 5]:
        got = rolling(df, "b", order_by=["id"], **how).apply(np.sum, raw=True, chunk_rows=chunk)
        same(got, pdf["b"].rolling(**how).apply(np.sum, raw=True))


def test_grouped_windows(df, pdf):
    weighted = lambda x: float((x * pd.Series(range(1, len(x)), dtype=float)).sum())
    got = rolling(df, "b", 4, ["id"], by=["g", "h"], min_periods=2).apply(np.sum, raw=True, chunk_rows=7)
    same(got, pdf.groupby(["g", "h"])["b"].rolling(4, min_periods=2).apply(np.sum, raw=True).reset_index(level=[0, 1], drop=True).sort_index())
    got = expanding(df, "b", ["id"], by="g").apply(weighted, index="id")
    # Labels are those of the group's own rows: pandas over each group. Its grouped form labels windows by other rows.
    same(got, pd.concat([g["b"].expanding().apply(weighted) for _, g in pdf.groupby("g")]).sort_index())


def test_time_windows(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:00", "2024-01-01 03:00", "2024-01-01 09:00", "2024-01-02 00:00"])
    pdf = pd.DataFrame({"id": range(5), "ts": ts, "v": [1.0, 2.0, 3.0, 4.0, 5.0]})
    df = spark.createDataFrame(pdf)
    for closed in ("right", "left", "both", "neither"):
        expected = pdf.set_index("ts")["v"].rolling("6h", closed=closed).sum()
        for chunk in (1, 100):
            same(rolling(df, "v", "6h", ["ts", "id"], closed=closed).apply(np.sum, raw=True, chunk_rows=chunk), expected)


def test_frames_are_checked():
    for how in ({"window": -1}, {"window": 3, "min_periods": 4}, {"window": 3, "closed": "up"}, {"window": 3, "step": 0}):
        with pytest.raises(ValueError):
            Frame(**how)


@pytest.mark.parametrize("kind", [RuntimeError, AttributeError, ZeroDivisionError])
def test_errors_keep_their_type(df, kind):
    def bad(x):
        raise kind("no")

    with pytest.raises(kind):
        errors.collect(apply_values(df, "a", bad, "double"))


def test_configuration(spark, df):
    with pytest.warns(DeprecationWarning):
        session.initialize(spark, nb_workers=3, shm_size_mb=10, use_memory_fs=False, verbose=0)
    assert apply_values(df, "a", float, "double").rdd.getNumPartitions() == 3
    session.initialize(spark)
    with Progress(spark, 300) as bar:
        apply_values(df, "a", float, "double", progress=bar).count()
        apply_values(df, "a", float, "double", progress=bar).collect()
    assert bar.done.value >= 300 and "%" in bar.line()


def test_streams(spark, df, tmp_path):
    df.select("id", "a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, a long").parquet(str(tmp_path / "in"))
    out = apply_values(stream, "a", float, "double", keys=["id"])
    q = out.writeStream.format("memory").queryName("values").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("values").count() == 300


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_condensed_columns(df, pdf, small_batches):
    seen = apply_columns(df, len, "long", columns=["a", "b"], condense=lambda x: (min(x), max(x))).toPandas()
    assert (seen["result"] < len(pdf) / 2).all()  # f meets what stands for the pieces, not the column
    got = apply_columns(df, lambda x: max(x) - min(x), "double", columns=["a"], condense=lambda x: (min(x), max(x))).toPandas()
    assert got["result"].tolist() == [pdf["a"].max() - pdf["a"].min()]
    none = apply_columns(df.filter("false"), max, "double", columns=["a"], condense=lambda x: (max(x),)).toPandas()
    assert none["result"].isna().tolist() == [True]
    ordered = apply_columns(df, lambda x: x.iloc[-1], "double", columns=["a"], order_by=["id"]).toPandas()
    assert ordered["result"].tolist() == [pdf["a"].iloc[-1]]
    with pytest.raises(ValueError):
        apply_columns(df, len, "long", columns=["a"], order_by=["id"], condense=list)


#: Queries whose many groups are batched.
BATCHED = ["group_apply_transform", "group_apply_topn", "group_rolling_multikey", "group_expanding_apply", "group_apply_series", "group_apply_args", "group_apply_scalar_multikey", "group_rolling_time"]


def test_groups_over_batches(spark, df, pdf, small_batches):
    """Groups of one row and of many batches; a null in one group leaves the integers of another alone."""
    moved = group_apply(df, ["g", "h"], lambda x: x["a"] - x["a"].mean(), "double", mode="transform", order_by=["id"], columns=["a"])
    same(moved, pdf["a"] - pdf.groupby(["g", "h"])["a"].transform("mean"))
    assert len(group_apply(df, "id", len, "long").filter("result = 1").collect()) == len(pdf)
    big = 2**60 + 1
    rows = spark.createDataFrame([(1, big, True), (1, big, False), (2, None, True), (2, 5, None), (None, big, True)], "k long, v long, t boolean").coalesce(1)
    got = group_apply(rows, "k", lambda x: f"{x['v'].dtype.kind}{x['t'].dtype.kind}{len(x)}", "string", columns=["v", "t"], dropna=False)
    assert pairs(got, "k", "result") == pairs(spark.createDataFrame([(1, "ib2"), (2, "fO2"), (None, "ib1")], "k long, result string"), "k", "result")
    exact = group_apply(rows, "k", lambda x: None if x["v"].isna().any() else int(x["v"].iloc[0]), "long", columns=["v"])
    assert pairs(exact, "k", "result") == [(1, big), (2, None)]
    nested = rows.selectExpr("struct(k) AS k", "v")
    assert sorted(r["result"] for r in group_apply(nested, "k", len, "long").collect()) == [1, 2, 2]


@pytest.mark.parametrize("name", BATCHED)
def test_many_groups_share_a_call(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_series_by_label(df, pdf):
    """A Series with the columns' labels is taken as it is; others are found by label."""

    class Unasked(pd.Series):
        def __getitem__(self, key):
            raise AssertionError("a label was looked up")

    want = pdf.groupby("g")["a"].agg(["mean", "size"]).reset_index()
    want = sorted(map(tuple, want.to_numpy().tolist()), key=str)
    made = lambda x: {"m": x["a"].mean(), "n": float(len(x))}
    for f in (lambda x: Unasked(made(x)), lambda x: pd.Series({"more": 0.0, "n": made(x)["n"], "m": made(x)["m"]}), made):
        got = group_apply(df, "g", f, "m double, n double", mode="series", columns=["a"])
        assert pairs(got, "g", "m", "n") == [pytest.approx(w) for w in want]


def test_groups_are_cut_without_iloc(monkeypatch):
    """iloc took more time than most functions."""
    rows = pd.DataFrame({"k": [1, 1, 2, 3], "v": [1, 2, 3, 4], "w": list("abcd"), NULL.format("v"): [False, False, True, False]})
    groups = next(whole_groups(iter([rows]), ["k"], ["k", "v", "w"], pieces=True))
    monkeypatch.setattr(pd.DataFrame, "iloc", property(lambda self: pytest.fail("iloc")))
    got = {k: g for k, g in groups}  # noqa: C416
    assert [k for k, in got] == [1, 2, 3] and all(g.index.equals(pd.RangeIndex(len(g))) for g in got.values())
    assert got[1,]["v"].tolist() == [1, 2] and got[2,]["v"].isna().all() and got[3,]["w"].tolist() == ["d"] and got[3,]["v"].dtype.kind == "i"
    got[1,]["w"], got[1,].index.name = "x", "mine"  # a group's columns and index are its own
    assert got[3,]["w"].tolist() == ["d"] and got[3,].index.name is None


def test_time_windows_are_sorted_once(spark, small_batches):
    plan = catalog.queries()["group_rolling_time"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    ids = [None, -2, 3, -5, None, 7, 8, 9]  # null ids come first, as Spark has them
    rows = [(k % 2, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k // 4)).to_pydatetime(), float(2**k)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "g long, i long, ts timestamp, v double").repartition(3)
    pdf = pd.DataFrame(rows, columns=["g", "i", "ts", "v"]).sort_values(["ts", "i"], na_position="first")
    want = {k: x.set_index("ts")["v"].rolling("1h").sum().tolist() for k, x in pdf.groupby("g")}
    for chunk in (1, 3, 100):
        got = rolling(df, "v", "1h", ["ts", "i"], by="g").apply(np.sum, raw=True, chunk_rows=chunk).toPandas().sort_values(["ts", "i"], na_position="first")
        assert {k: x["result"].tolist() for k, x in got.groupby("g")} == want


def test_frames_as_columns(df, pdf):
    got = group_apply(df, "g", lambda x: {"least": [x["a"].min()], "n": [len(x)]}, "least long, n long", mode="frame", columns=["a"])
    want = pdf.groupby("g")["a"].agg(["min", "size"]).reset_index()
    assert pairs(got, "g", "least", "n") == sorted(map(tuple, want.to_numpy().tolist()), key=str)


def test_windows_over_batches(df, pdf, small_batches):
    for how in FRAMES[::5]:
        got = rolling(df, "b", order_by=["id"], by=["g", "h"], **how).apply(np.sum, raw=True, chunk_rows=9)
        want = pd.concat([x["b"].rolling(**how).apply(np.sum, raw=True) for _, x in pdf.groupby(["g", "h"])]).sort_index()
        same(got, want)
    calls = rolling(df, "a", 4, ["id"], by="g").apply(lambda x: float(len(x.index) and x.index[-1]), chunk_rows=9)
    same(calls, pd.concat([x["a"].reset_index(drop=True).rolling(4).apply(lambda w: float(w.index[-1])).set_axis(x.index) for _, x in pdf.groupby("g")]).sort_index())


def test_condensed_groups(df, pdf, small_batches):
    part = lambda x: {"total": [x["a"].sum()], "n": [len(x)]}
    got = group_apply(df, ["g", "h"], lambda p: p["total"].sum() / p["n"].sum(), "double", columns=["a"], condense=part, condensed="total double, n long")
    want = pdf.groupby(["g", "h"])["a"].mean().reset_index()
    assert pairs(got, "g", "h", "result") == [pytest.approx(w) for w in sorted(map(tuple, want.astype(object).to_numpy().tolist()), key=str)]
    seen = group_apply(df, "h", len, "long", columns=["a"], condense=part, condensed="total double, n long").toPandas()
    assert (seen["result"] < len(pdf) / 4).all()
    with pytest.raises(ValueError):
        group_apply(df, "g", len, "long", mode="transform", order_by=["id"], condense=part, condensed="n long")
