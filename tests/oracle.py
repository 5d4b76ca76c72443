"""Comparison of a query with its SQL on one data folder."""

import glob
import os

import duckdb


def tables(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return tuple(map(one, v))
        return repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


def assert_same(spark, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    relation = tables(folder).sql(sql)
    assert sorted(relation.columns) == columns
    names = ", ".join(f'"{n}"' for n in columns)
    expected = tables(folder).sql(f"select {names} from ({sql})").fetchall()
    assert canonical(got) == canonical(expected)
