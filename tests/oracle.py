"""Compares a registered query with its SQL twin."""

import os

import duckdb


def value(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return str(v) if hasattr(v, "isoformat") else v


def compare(spark, name, folder):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    cur = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert ours == theirs
    return ours
