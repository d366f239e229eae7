"""Every registered core query against its SQL, on the smallest tables."""

import os

import pytest

from pagemill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, tmp_path, name):
    out = catalogue.queries()[name](spark, SF)
    out.write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
    duck.execute(f"create or replace temp table a as select {columns} from '{tmp_path}/out/*.parquet'")
    duck.execute(f"create or replace temp table b as select {columns} from ({catalogue.oracle_sql()[name]})")
    assert duck.sql("select count(*) from b").fetchall()[0][0] == spark.read.parquet(f"{tmp_path}/out").count()
    assert duck.sql("select * from a except all select * from b").fetchall() == []
    assert duck.sql("select * from b except all select * from a").fetchall() == []


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
