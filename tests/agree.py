"""Compare a Spark result with what DuckDB makes of the SQL beside it: columns by name, rows as a multiset."""

from collections import Counter


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_agree(df, duck, sql):
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns)
    assert got == want, f"{sum((got - want).values())} rows are not in SQL's, {sum((want - got).values())} are missing; {list((got - want).items())[:3]} {list((want - got).items())[:3]}"
