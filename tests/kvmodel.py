"""The meaning of an op log in plain Python: what every operator is held against."""


def snapshot(ops, seq=None):
    """ops: (key, seq, value, deleted) in any order."""
    last = {}
    for key, at, value, deleted in ops:
        if (seq is None or at <= seq) and (key not in last or last[key][0] < at):
            last[key] = (at, value, deleted)
    return {k: v for k, (_, v, gone) in last.items() if not gone}


def log(*steps):
    """puts are (key, value), deletes (key,); numbered from 1."""
    return [(s[0], i + 1, s[1] if len(s) > 1 else None, len(s) == 1) for i, s in enumerate(steps)]


SCHEMA = "key string, seq long, value string, deleted boolean"


def frame(spark, ops):
    return spark.createDataFrame(list(ops), SCHEMA)


def as_dict(df):
    return {r.key: r.value for r in df.collect()}
