"""The polling loops of a market desk as Structured Streaming jobs over files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketspark.operators.lineage import cut
from marketspark.streaming.store import Store, last_of, newest


def work_folder(spark: SparkSession) -> str:
    cut(spark.range(0))  # sets a folder where none is set
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema of what is stored there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def unseen(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "40 days") -> DataFrame:
    """Each key once; the watermark bounds what must be remembered, a key that comes back after it is new again."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that is available now, appended to Parquet under the folder, then read."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def keyed(spark: SparkSession) -> None:
    """Streams started from now on keep their keyed state in RocksDB: on the executors' disks, with what a batch changes
    in the checkpoint, whatever the number of keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _served(stream: DataFrame, serve: Callable[[DataFrame, int], object], folder: str) -> None:
    stream.writeStream.foreachBatch(serve).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start().awaitTermination()


def upserted(stream: DataFrame, folder: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over all batches, restarts included.

    A batch adds a piece with its own last rows (see store.Store) and a read merges the pieces, so a batch writes as much as
    it brings, and its share of later merges. Readers see whole batches; a batch that runs again changes nothing. Rows of
    equal order: the later batch's. Before any data there are no rows."""
    held = Store(stream.sparkSession, folder, newest(keys, order))
    _served(stream, lambda batch, number: held.add(batch, number), folder)
    rows = held.merged()
    return rows if rows is not None else stream.sparkSession.createDataFrame([], stream.schema)


def counted(stream: DataFrame, key: str, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event-time windows per key, closed by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def marked_once(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Each key once, whatever batch it comes in. Seen keys are the stream's keyed state; a batch writes only keys that are
    new."""
    keyed(stream.sparkSession)
    return drained(stream.select(*keys).dropDuplicates(keys), folder)


def by_day(stream: DataFrame, folder: str, day: str, keys: list[str] | None = None, finished: bool = True) -> DataFrame:
    """All rows of the days that are whole, over all batches and restarts.

    A day is whole once a row of a later day has come, or, if `finished`, once all that is there has been read (the upstream
    has closed it). Rows may come in any number of batches; a late row of a whole day is there with the batch that brings
    it. keys: a day's row that comes again replaces what earlier batches brought with the same keys; without keys every row
    stays. The last whole day is committed together with the batch (see store.Store), so nobody sees half a day, and a
    batch that runs again changes nothing. Rows without a day are kept, but no day shows them."""
    spark = stream.sparkSession
    held = Store(spark, folder, last_of([day, *keys]) if keys else None)

    def closed(note: dict | None, rows: DataFrame) -> dict:
        last = rows.agg(F.max(F.to_date(day)).cast("string"), F.date_sub(F.max(F.to_date(day)), 1).cast("string")).first()
        so_far = note or {"seen": "", "whole": ""}
        return {"seen": max(so_far["seen"], last[0] or ""), "whole": max(so_far["whole"], last[1] or "")}

    _served(stream, lambda batch, number: held.add(batch, number, closed), folder)
    state = held.state()
    if finished and state["note"] and state["note"]["whole"] < state["note"]["seen"]:
        held.commit(state | {"note": {"seen": state["note"]["seen"], "whole": state["note"]["seen"]}})
    return whole_days(spark, folder, day, stream.schema, keys)


def whole_days(spark: SparkSession, folder: str, day: str, schema: StructType, keys: list[str] | None = None) -> DataFrame:
    """What by_day() has committed, for readers beside the stream."""
    held = Store(spark, folder, last_of([day, *keys]) if keys else None)
    state = held.state()
    rows = held.rows(state["pieces"])
    if rows is None:
        return spark.createDataFrame([], schema)
    shown = rows.where(F.to_date(day) <= F.lit(state["note"]["whole"] or None).cast("date"))
    return (held.merge(shown) if held.merge else shown).select(*schema.names)


def answered(stream: DataFrame, folder: str, key: str, answer: Callable[[DataFrame], DataFrame], skip: Column | None = None) -> DataFrame:
    """An inbox of requests and its outbox: each new key is answered once, by answer(requests) -> rows with the key; skipped
    requests never are. A request without an answer is recorded with the error "no answer"; if a batch fails as a whole,
    each of its requests is recorded with the error's type and the stream goes on. Which keys have come is the stream's
    keyed state, so a batch holds and writes new requests only; one that runs again overwrites its own folder of the
    outbox."""
    spark = stream.sparkSession
    keyed(spark)

    def serve(batch: DataFrame, number: int) -> None:
        asked = cut(batch)
        try:
            rows = cut(answer(asked))
            failed = asked.join(rows, key, "left_anti").select(key, F.lit("no answer").alias("error"))
            rows.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True).write.mode("overwrite").parquet(f"{folder}-out/batch={number}")
        except Exception as e:  # a bad request must not stop the inbox
            asked.select(key, F.lit(type(e).__name__).alias("error")).write.mode("overwrite").parquet(f"{folder}-out/batch={number}")

    asked = stream.where(~F.coalesce(skip, F.lit(False))) if skip is not None else stream
    _served(asked.dropDuplicates([key]), serve, folder)
    return spark.read.option("mergeSchema", True).parquet(f"{folder}-out").drop("batch")
