"""The named queries: complete, and equal to their SQL on a sample of them (set PULSEGRID_ALL=1 for every one)."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("W10_episodes", "S6_exposition_sink", "J6_asof_join", "A6_quantiles", "A14_slice_table", "W2_increase", "W9_open_suppression", "W17_retention", "F24_probe_classification", "R6_AnomalieApplication", "U2_absent", "T3_event_records", "T6_guarded_decisions", "T9_trailing_windows", "R2_CpuEleve")
EXPECTED = {"S": 14, "P": 11, "J": 16, "A": 22, "W": 20, "O": 5, "U": 5, "F": 26, "M": 13, "E": 11, "R": 34, "T": 10, "D": 6, "B": 4}


def test_every_inventory_id_has_a_query():
    ids = {re.match(r"([A-Z]\d+)_", n).group(1) for n in QUERIES}
    assert ids == {f"{k}{i}" for k, n in EXPECTED.items() for i in range(1, n + 1)}
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"M4_forest_score", "M7_champion_challenger"}


def shown(value):
    return repr(float(value)) if isinstance(value, float) else repr(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("PULSEGRID_ALL") else SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_entry(spark):
    assert entry.entry(spark).columns == ["target", "start", "end", "rows"]
    assert set(entry.queries()) >= set(QUERIES) and entry.oracle_sql().keys() >= SQL.keys()
