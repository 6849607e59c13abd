"""A few registered queries against their SQL, and that names agree."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["edges_nation", "diffusion", "laplacian_normalized", "similarity_spearman", "threshold_top", "kendall", "sweep_cut", "transition_windows", "current_flow", "effective_resistance", "edge_ablation", "wavelet_report", "csv_round_trip", "still_perturbations", "single_paths"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    rel = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})")
    want = sorted(rel.fetchall(), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, int | float) for x in a) else a == b
