"""Small graphs built by hand."""

from graphloom import schema


def nodes(spark, *rows):
    """(id, kind, name, file_path[, start_line, end_line])"""
    made = [(r[0], r[1], r[2], r[2], r[3], *(r[4:6] if len(r) > 4 else (1, 1))) for r in rows]
    names = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int"
    return schema.conform(spark.createDataFrame(made, names), schema.NODES)


def edges(spark, *rows):
    """(source, kind, target[, line])"""
    made = [(r[0], r[2], r[1], r[3] if len(r) > 3 else 1) for r in rows]
    return schema.conform(spark.createDataFrame(made, "source string, target string, kind string, line int"), schema.EDGES)


def chain(spark):
    n = nodes(spark, *[(x, "function", x, f"{x}.go") for x in ("main", "Run", "Alpha", "helper")])
    return n, edges(spark, ("main", "calls", "Run"), ("Run", "calls", "Alpha"), ("Alpha", "calls", "helper"))


def dispatch(spark):
    n = nodes(
        spark,
        ("I", "interface", "I", "i.go"), ("A", "struct", "A", "a.go"), ("B", "struct", "B", "b.go"),
        ("A.m", "method", "m", "a.go"), ("B.m", "method", "m", "b.go"), ("B.x", "method", "x", "b.go"),
        ("ca", "function", "ca", "c.go"), ("cb", "function", "cb", "c.go"),
    )
    e = edges(
        spark,
        ("A", "implements", "I"), ("B", "implements", "I"), ("A", "contains", "A.m"), ("B", "contains", "B.m"), ("B", "contains", "B.x"),
        ("ca", "calls", "A.m"), ("cb", "calls", "B.m"),
    )
    return n, e
