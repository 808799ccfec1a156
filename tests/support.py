"""What tests share: the smallest tables, and comparison with SQL."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


def same_rows(df, con, sql):
    """The rows of a DataFrame and of a SQL text, as sorted lists."""
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in q.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    return ours, theirs
