"""What tests share."""

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(frame, con, sql):
    """Whether a DataFrame and a SQL text give the same rows under the same names."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in theirs), key=repr)
