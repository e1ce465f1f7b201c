"""Postings of a stream of documents: an index that grows as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.index import postings


def append_postings(docs: DataFrame, path: str, checkpoint: str, nltk: bool = False) -> StreamingQuery:
    """Starts a query that appends the postings of each new batch of a streaming docs(doc_id, text) to a Parquet index.

    Documents are independent of each other, so no state is kept; a repeated batch replaces its own folder, so that
    each document is indexed once. Doc ids must not recur in later batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, nltk).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
