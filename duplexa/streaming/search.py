"""Queries that arrive as files, searched on a stored database as they come: each batch is a search of its own, as results are per query. Result ids go on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.search import SearchParameters, numbered, search_store
from ..sources.settled import settled
from ..sources.store import Store

SCHEMA = "seq_id long, name string, seq string"
_IDS = "batch long, first long, next long"


def _next_id(spark: SparkSession, ids: str, number: int) -> int:
    """The id after those of the batch before, as it was written when that batch ended; so a batch that is done again gets the ids it had."""
    if number == 0:
        return 0
    return spark.read.schema(_IDS).parquet(f"{ids}/batch={number - 1}").select("next").first()[0]


def stream_search(spark: SparkSession, incoming: str, database: str, results: str, state: str, parameters: SearchParameters = SearchParameters()) -> StreamingQuery:
    """Search every Parquet file (SCHEMA) that comes to a folder. Results have id, numbered on from the batch before in the order of query, target and place; where ids begin and end is kept for each batch in `state`/ids. Batches that are done
    are known from `state`, and a batch that is done again overwrites its own folder of results, with the same ids."""
    store, ids = Store.open(spark, database), f"{state}/ids"

    def batch(queries: DataFrame, number: int) -> None:
        first = _next_id(spark, ids, number)
        hits = settled(search_store(queries, store, parameters))
        numbered(hits, first).write.mode("overwrite").parquet(f"{results}/batch={number}")
        spark.createDataFrame([(number, first, first + hits.count())], _IDS).coalesce(1).write.mode("overwrite").parquet(f"{ids}/batch={number}")

    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()
