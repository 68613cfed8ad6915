"""Rows of Spark and DuckDB in one comparable form."""

import math


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(row[n]) for n in names) for row in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(cell(row[i]) for i in order) for row in result.fetchall())
