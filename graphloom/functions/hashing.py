"""Identifiers and digests as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(x: Column) -> Column:
    """Length (base-128, low digits first) and bytes of a string."""
    n = F.octet_length(x)
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    low = byte((n % 128).cast("int"))
    two = F.concat(byte((n % 128 + 128).cast("int")), byte(F.shiftright(n, 7).cast("int")))
    three = F.concat(
        byte((n % 128 + 128).cast("int")), byte((F.shiftright(n, 7) % 128 + 128).cast("int")), byte(F.shiftright(n, 14).cast("int"))
    )
    size = F.when(n < 128, low).when(n < 16384, two).otherwise(three)
    return F.concat(size, x.cast("binary"))


def node_id(kind: Column, qualified_name: Column, file_path: Column) -> Column:
    """kind + ":" + the first 32 hex digits of a SHA-256 over length-prefixed kind, qualified name and path."""
    body = F.concat(_segment(kind), _segment(qualified_name), _segment(file_path))
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(body, 256), 1, 32))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
