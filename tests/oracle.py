"""Compares a query with its SQL, rows in any order, values exactly."""

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def same(frame, relation):
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    at = [list(relation.columns).index(c) for c in names]
    ours = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
