"""What the tests share."""

import os

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that both engines give alike."""
    import datetime
    import math

    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
