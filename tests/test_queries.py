from __future__ import annotations

import pytest
from sqlcheck import SMALL, same

from meshlake.plans import queries as q
from meshlake.plans import source_queries  # noqa: F401  registers its queries


@pytest.mark.parametrize("name", list(q.queries()))
def test_rows_equal_those_of_the_sql(spark, name):
    same(q.queries()[name](spark, SMALL), q.oracle_sql()[name])


def test_lists_hold_all_orders(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    got = q.queries()["extractlist_whole"](spark, SMALL).collect()
    assert sorted(r["row_id"] for r in got) == list(range(len(orders)))
    assert {(r["list_id"], r["pos"]) for r in got} == {(r["o_custkey"], r["o_orderkey"]) for r in orders}
    chosen = {r[0] for r in spark.read.parquet(f"{SMALL}/supplier.parquet").select("s_suppkey").collect()}
    halos = q.queries()["ahfhalolist_whole"](spark, SMALL).collect()
    assert {(r["list_id"], r["pos"]) for r in halos} == {(r["o_custkey"], r["o_orderkey"]) for r in orders if r["o_custkey"] in chosen}


def test_split_by_value_deals_every_row(spark):
    price = {r["o_orderkey"]: float(r["o_totalprice"]) for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()}
    part = {r["__row"]: r["part"] for r in q.queries()["splittable_field_rows"](spark, SMALL).collect()}
    assert set(part) == set(price) and set(part.values()) == {0, 1, 2, 3}
    dealt = [part[k] for k in sorted(price, key=price.get)]
    assert dealt == sorted(dealt)  # no row of a part lies among those of another


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["__row", "density"]
    assert set(e.oracle_sql()) <= set(e.queries())
