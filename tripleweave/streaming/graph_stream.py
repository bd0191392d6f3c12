"""Graph tables kept up to date from a stream of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleweave.operators.graph import graph_links, graph_nodes

TRIPLE = "s string, p string, o string, o_is_literal boolean"


def stream_graph(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follow a folder of parquet triples; every batch writes its part of the graph tables.

    A batch writes to a folder named after its id and overwrites it when repeated, so a
    restart after a lost driver neither loses nor doubles anything.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        nodes, links = graph_nodes(batch), graph_links(batch)
        nodes.drop("display").write.mode("overwrite").parquet(f"{target}/nodes/batch={batch_id}")
        links.write.mode("overwrite").parquet(f"{target}/links/batch={batch_id}")

    stream = spark.readStream.schema(TRIPLE).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 seconds")
    return writer.start()


def current_nodes(spark: SparkSession, target: str) -> DataFrame:
    """All batches as one node table; the parts of a node are joined by ``max``."""
    parts = spark.read.parquet(f"{target}/nodes")
    return parts.groupBy("id").agg(*[F.max(c).alias(c) for c in ("literal", "value", "class_uri", "label")])


def current_links(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/links").select("source", "target", "predicate").distinct()
