"""Rows of both engines in one form."""

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return value


def assert_same(frame, con, sql):
    columns = sorted(frame.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    assert ours == theirs
