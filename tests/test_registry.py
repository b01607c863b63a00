"""Every registered query against its oracle on the smallest data, and the shape of the registry."""

import re
from pathlib import Path

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "total_transbordos" in df.columns and df.count() > 0


def test_every_operator_is_registered():
    groups = {"S": 24, "T": 10, "C": 7, "P": 22, "J": 14, "A": 18, "W": 11, "L": 6, "U": 3, "M": 38, "Q": 25, "D": 19}
    have = {m.group() for n in QUERIES if (m := re.match(r"[A-Z]\d\d", n))}
    missing = {f"{g}{i:02d}" for g, n in groups.items() for i in range(1, n + 1)} - have
    assert missing == set()
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_against_oracle(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", ["D08_recommended", "D09_all_predictors", "D10_all_predictors", "D15_card_segments", "D16_all_predictors"])
def test_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_fragile_or_unbounded_calls():
    source = "\n".join(p.read_text() for p in (ROOT / "corredor").rglob("*.py"))
    assert "localCheckpoint" not in source
    assert not re.search(r"\.crossJoin\(|\.rdd\b|toPandas\(|F\.udf\(", source)
