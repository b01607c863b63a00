import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corredor.operators import aggregates, windows


def events(spark, data):
    return spark.createDataFrame(data, "k string, s bigint, v bigint")


def brute(data):
    out = {}
    for key, group in itertools.groupby(sorted(data, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        group = list(group)
        last = top = None
        for i, (_, s, v) in enumerate(group):
            last = v if v is not None else last
            top = v if top is None or (v is not None and v > top) else top
            before = group[i - 1][1] if i else None
            after = group[i + 1][1] if i + 1 < len(group) else None
            out[(key, s)] = (before, after, last, top)
    return out


def spread(df, hot_rows, width=3):
    found = windows.ordered_context(
        df, ["k"], ["s"], F.floor(F.col("s") / width), previous=["s"], following=["s"],
        running_last={"last": F.col("v")}, running_max={"top": F.col("v")}, hot_rows=hot_rows,
    )
    return {(r["k"], r["s"]): (r["prev"] and r["prev"]["s"], r["next"] and r["next"]["s"], r["last"], r["top"])
            for r in found.collect()}


@pytest.mark.parametrize("hot_rows", [1, 5, 1_000_000])
def test_context_equals_brute_force_with_a_hot_key(spark, hot_rows):
    rng = random.Random(7)
    # one key owns most of the rows
    data = [("hot", s, rng.choice([None, s])) for s in rng.sample(range(400), 90)]
    data += [(f"k{i}", s, rng.choice([None, s])) for i in range(6) for s in rng.sample(range(50), 4)]
    assert spread(events(spark, data), hot_rows) == brute(data)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), min_size=1), st.integers(1, 7))
def test_context_property(spark, places, width):
    data = [(k, s, s if s % 3 else None) for k, s in places]
    assert spread(events(spark, data), 1, width) == brute(data)


def test_hot_cells_are_those_of_hot_keys(spark):
    df = events(spark, [("hot", s, 0) for s in range(50)] + [(f"k{i}", 0, 0) for i in range(20)])
    own = {r["cell"] for r in df.filter("k = 'hot'").select(windows.key_cell(["k"]).alias("cell")).collect()}
    assert windows.hot_cells(df, ["k"], 10) == sorted(own)
    assert windows.hot_cells(df, ["k"], 51) == windows.hot_cells(df.limit(0), ["k"], 1) == []


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_ordered_operators_scan_and_shuffle_their_rows_once(spark, tmp_path, hot_rows):
    path = str(tmp_path / "rows")
    events(spark, [("hot", s, s) for s in range(60)] + [(f"k{i}", 0, 0) for i in range(20)]).write.parquet(path)
    out = windows.ordered_context(
        spark.read.parquet(path), ["k"], ["s"], F.floor(F.col("s") / 7), previous=["s"], following=["s"],
        running_last={"last": F.col("v")}, hot_rows=hot_rows,
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    # with a hot key the rows are read when their slots are stored: the plan holds the stored rows only
    assert plan.count("FileScan") == (0 if hot_rows == 10 else 1)
    if hot_rows > 10:
        assert plan.count("Exchange") == 1
    assert out.count() == 80 and out.filter("s > 0 and prev.s <> s - 1").isEmpty()


def test_first_and_later_rows_partition_the_input(spark):
    data = [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 1, 4), (None, 1, 5), (None, 1, 6)]
    df = events(spark, data)
    first = windows.keep_first(df, ["k", "s"], ["v"])
    later = windows.later_duplicates(df, ["k", "s"], ["v"], "v")
    assert sorted(r["v"] for r in first.collect()) == [1, 4, 5]
    assert sorted(r["v"] for r in later.collect()) == [2, 3, 6]


def test_first_row_is_limited_before_the_shuffle(spark):
    df = events(spark, [("a", 1, 1)])
    plan = windows.keep_first(df, ["k"], ["v"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_numbering_does_not_depend_on_input_order(spark):
    data = [("t", 1, 3), ("t", 1, 1), ("t", 1, 2), ("s", 9, 9)]
    for perm in itertools.permutations(data):
        df = events(spark, list(perm)).repartition(3)
        got = {r["v"]: r["n"] for r in windows.number_rows(df, ["k", "s", "v"], "n", "TU-").collect()}
        assert got == {9: "TU-1", 1: "TU-2", 2: "TU-3", 3: "TU-4"}


def test_running_totals(spark):
    df = events(spark, [("a", s, s % 5) for s in range(200)]).repartition(7)
    got = {r["s"]: r["t"] for r in windows.prefix_sum(df, ["s"], {"v": "t"}).collect()}
    assert got == {s: sum(i % 5 for i in range(s + 1)) for s in range(200)}


def test_ranks_with_ties(spark):
    df = events(spark, [("a", 0, 5), ("b", 0, 5), ("c", 0, 3), ("d", 0, None)])
    got = {r["k"]: r["ranking"] for r in windows.rank_desc(df, "v").collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 4}


def test_medians_of_even_odd_and_null_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 4.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", 9.0), ("c", None)], "g string, x double"
    )
    got = {r["g"]: r["mediana_x"] for r in aggregates.medians(df, ["g"], ["x"]).collect()}
    assert got == {"a": 2.5, "b": 2.0}


def test_fingerprint_ignores_order_and_sees_copies(spark):
    a = events(spark, [("a", 1, 1), ("b", 2, None)])
    same = events(spark, [("b", 2, None), ("a", 1, 1)])
    more = events(spark, [("a", 1, 1), ("b", 2, None), ("b", 2, None)])
    prints = [aggregates.fingerprint(d).head() for d in (a, same, more)]
    assert prints[0] == prints[1] != prints[2]
