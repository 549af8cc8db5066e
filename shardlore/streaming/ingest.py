"""Prose trees as a stream: new files are parsed as they come.

The engine's indexes are built in batch; this feeds the same parser from
Structured Streaming's file source, for trees that grow.  Ids need the whole
table, so they are given when the collected sections are indexed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.parsing import parse_prose
from ..sources.trees import doc_files, relative


def prose_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Sections of each new RST or Markdown file below root."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)
    return parse_prose(doc_files(files.withColumn("rel", relative(root))))


def write_sections(sections: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return sections.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
