"""Each query against its SQL, and the parsers' edge cases."""

import duckdb
import pytest

from lectern.operators import chunks, html
from lectern.plans import more, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(str(tuple(r)) for r in found.select(*columns).collect())
    if name in registry.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        made = con.execute(registry.ORACLE_SQL[name])
        at = [[c[0] for c in made.description].index(c) for c in columns]
        assert rows == sorted(str(tuple(r[i] for i in at)) for r in made.fetchall())
