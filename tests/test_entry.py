"""The driver's contract."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["a26_node_set", "f8_r25_candidates", "w5_segments", "t7_j4_j5_samples", "t13_w8_rl_rows", "a22_kept_means", "w4_f17_micro_frame", "r3_r7_checked", "p5_found", "p6_found"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA), duck.execute(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert columns == sorted(names)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
