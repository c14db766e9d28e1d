"""Small builders shared by the tests."""

import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(df, *order):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def column(df, name, key):
    return {r[key]: r[name] for r in df.collect()}
