"""The survey view equals the fixture definition row for row (DuckDB on the
literal fixture SQL vs Spark on the overflow-safe form)."""

import os
import re

import duckdb
import pytest

from inclusio.sources import survey_view as SV

FIXTURES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_view_equals_fixture(spark, sf):
    d = f"/root/testdata/sf{sf}"
    text = open(FIXTURES, encoding="utf-8").read()
    fixture = re.search(r"```sql\n(.*?)```", text, re.S).group(1)
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    exp = con.execute(fixture).fetchall()
    cols = [c[0] for c in con.description]
    got = SV.survey_all(spark, d).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(exp, key=repr)


def test_hash_has_no_overflow(spark):
    from pyspark.sql import functions as F
    big = spark.range(1).select(F.lit(15_000_000_123).alias("k"))
    row = big.selectExpr(*[f"{SV._hash(i)} AS h{i}" for i in range(30)]).first()
    for i in range(30):
        p = SV.PRIMES[i]
        k = 15_000_000_123
        assert row[f"h{i}"] == (3 * k * k + (2 * i + 5) * k + (7 * i + 1)) % p
