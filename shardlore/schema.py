"""Table layouts of an index: sections, links, vectors, postings, meta."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("rst", "html", "code")
LINK_KINDS = ("ref", "doc", "option", "file")
VERSION = 2


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TEXTS = T.ArrayType(T.StringType())
#: What a parser yields for one file; ``ord`` is the place within it.
PARSED = _struct(
    ("file_key", TEXTS), ("ord", T.IntegerType()), ("repo", T.StringType()), ("file_path", T.StringType()), ("anchor", T.StringType()), ("breadcrumb", T.StringType()),
    ("header", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("text", T.StringType()), ("all_anchors", TEXTS),
    ("raw_links", TEXTS), ("docname", T.StringType()), ("source_kind", T.StringType()), ("fell_back", T.BooleanType()),
)
SECTIONS = _struct(
    ("corpus", T.StringType()), ("id", T.LongType()), ("repo", T.StringType()), ("file_path", T.StringType()), ("anchor", T.StringType()), ("breadcrumb", T.StringType()),
    ("header", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("text", T.StringType()), ("source_kind", T.StringType()), ("all_anchors", TEXTS),
)
LINKS = _struct(("src_id", T.LongType()), ("kind", T.StringType()), ("target_raw", T.StringType()), ("resolved_id", T.LongType()), ("edge", T.LongType()))
META = _struct(("key", T.StringType()), ("value", T.StringType()))


def vectors(dim: int) -> T.StructType:
    """The vector table; dim is checked when it is written."""
    return T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType(), False), metadata={"dim": dim})])
