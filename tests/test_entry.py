"""The driver's contract: queries run, and SQL gives the same rows on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = ("canonical_names", "collapse_duplicates", "exact_pairs", "shortlist_topk", "rescue_crosswalk", "units_flags", "p6_found", "p6_from_keys", "adjudicated_crosswalk", "rescue_choices", "resumed_decisions", "matched_types", "order_fingerprint")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in result.fetchall()), key=repr) and got
