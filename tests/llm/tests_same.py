"""Comparing rows of Spark with rows of DuckDB, without order."""


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(rows, columns, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    order = sorted(names)
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
