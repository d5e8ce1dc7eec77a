import duckdb
import pytest

import __spark_entry__
from larderflow.operators import commands, compositions, household, library, logs, planning, relational, scalars, webpages, weeks  # noqa: F401  (they register their queries)

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["p_partkey", "demand", "packages"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_query_equals_its_sql(spark, sql, tmp_path, name):
    relational.QUERIES[name](spark, SMALL).write.parquet(f"{tmp_path}/out")
    sql.execute(f"create or replace table a as {relational.ORACLES[name]}")
    sql.execute(f"create or replace table b as select * from '{tmp_path}/out/*.parquet'")
    shape = [sorted(tuple(r[:2]) for r in sql.execute(f"describe {t}").fetchall()) for t in "ab"]
    assert shape[0] == shape[1]
    columns = ", ".join(f'"{c}"' for c, _ in shape[0])
    for x, y in ("ab", "ba"):
        assert sql.execute(f"select count(*) from (select {columns} from {x} except all select {columns} from {y})").fetchall() == [(0,)]


def test_every_supplier_has_its_parts(spark):
    suppliers = [(k, k % 5) for k in (3, 4, 8, 12, 13, 500, 997)]
    parts = [(1, "Red Widget", 3, "ECONOMY"), (2, "red red", 2, "promo"), (3, "blue", 27, "economy"), (4, None, 2, "widget")]
    term = {0: "red", 1: "widget", 2: "economy"}
    want = {(k, p) for k, nation in suppliers for p, name, size, kind in parts if name is not None and term[k % 3] in [*name.lower().split(" "), kind.lower()] and (k % 2 or nation == size % 25)}
    s = spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long")
    p = spark.createDataFrame(parts, "p_partkey long, p_name string, p_size long, p_type string")
    got = [tuple(r) for r in relational.term_members(s, p).collect()]
    assert {k for k, _ in got} - set(range(12))
    assert set(got) == want and len(got) == len(want)


def test_chains_without_a_beginning_are_left_out(spark):
    from larderflow.operators.chains import chains

    links = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (10, 99), (11, 10), (20, 21), (21, 20), (30, None)]
    got = sorted(tuple(r) for r in chains(spark.createDataFrame(links, "id long, previous long")).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 5), (30, 30, 1)]
    assert chains(spark.createDataFrame([], "id long, previous long")).count() == 0
