"""Results of a query and of its SQL in DuckDB, as sorted rows of plain values."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata")


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, _sorted(df.select(*columns).collect())


def duckdb_rows(sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        found = c.sql(sql)
        names = found.columns
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in order], _sorted([tuple(r[i] for i in order) for r in found.fetchall()])
