"""Ranks do not depend on the order in which rows come."""

import datetime

import duckdb
import pandas as pd
import pytest

from shotloom.plans import catalogue


@pytest.mark.parametrize("name", ["kg_related", "kg_related_all"])
def test_relations_with_one_weight_and_number_have_an_order(spark, tmp_path, name):
    # lines of one order and number, one supplier and quantity, but different parts and flags; only some of them are among the ten
    day = datetime.datetime(1995, 1, 1)
    rows = [(1, p, 7, 1, 50.0, 1.0, 0.0, 0.0, flag, status, day) for p in range(14) for flag in "NA" for status in "FO"]
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    seen = []
    for k, some in enumerate((rows, rows[::-1], rows[17:] + rows[:17])):
        folder = tmp_path / str(k)
        folder.mkdir()
        pd.DataFrame(some, columns=columns).astype({"l_shipdate": "datetime64[us]"}).to_parquet(folder / "lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
        df = catalogue.queries()[name](spark, str(folder))
        got = con.execute(catalogue.oracle_sql()[name])
        order = [d[0] for d in got.description]
        seen += [sorted(got.fetchall()), sorted(tuple(r[c] for c in order) for r in df.collect())]
    assert len(seen[0]) == 14 * 4 + 10 and all(s == seen[0] for s in seen)
