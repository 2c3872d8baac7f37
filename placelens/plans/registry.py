"""Named queries: each takes (spark, sf_dir) and returns a DataFrame."""

QUERIES = {}


def query(name=None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        return fn
    return add
