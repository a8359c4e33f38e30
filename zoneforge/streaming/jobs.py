"""Incremental work as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zoneforge import schemas
from zoneforge.functions.storage import new_path
from zoneforge.sources.readers import parse_annotation_responses
from zoneforge.sources.store import read_table, write_dataset
from zoneforge.streaming.epochs import EpochTable, SeenKeys

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_annotations(spark: SparkSession, src: str, dst: str, files: int | None = None) -> DataFrame:
    """Responses (JSON files of pdb_id, http_status, payload) to ``dst``, each structure's first one, parsed.

    The query keeps no state: an epoch asks the stored structures, in its own structures' buckets alone, and
    replaces its own part if it is run again. The checkpoint remembers files, so a rerun adds only what is new.
    """
    rows = spark.readStream.schema("pdb_id string, http_status int, payload string").option("pathGlobFilter", "*.json")
    rows = (rows if files is None else rows.option("maxFilesPerTrigger", files)).json(src)
    seen, data = SeenKeys(spark, f"{dst}/seen", "pdb_id"), EpochTable(spark, f"{dst}/data")

    def put(batch: DataFrame, epoch: int) -> None:
        fresh = seen.unseen(batch.dropDuplicates(["pdb_id"]), epoch)
        data.compact(epoch)
        data.put(parse_annotation_responses(fresh), epoch)
        seen.put(batch, epoch)

    _run(rows.writeStream.option("checkpointLocation", f"{dst}/checkpoint").foreachBatch(put))
    return data.read()


def _means(sums: DataFrame) -> DataFrame:
    return sums.groupBy("zone_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def stream_curriculum(spark: SparkSession, src: str, schema: str = schemas.CURRICULUM, dst: str | None = None, files: int | None = None) -> DataFrame:
    """Mean difficulty by zone over a folder of score files, as they come.

    An epoch adds the sums of its own zones, so what it writes hangs on it alone; sums of a zone meet when
    they are read, and now and then become one. With ``dst`` a later run goes on where the last one ended.
    """
    dst = dst or new_path(spark, "curriculum")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    rows = (rows if files is None else rows.option("maxFilesPerTrigger", files)).parquet(src)
    table = EpochTable(spark, f"{dst}/sums", combine=_means)

    def put(batch: DataFrame, epoch: int) -> None:
        table.compact(epoch)
        table.put(batch.groupBy("zone_id").agg(F.sum("difficulty").alias("total"), F.count("difficulty").alias("n")), epoch)

    _run(rows.writeStream.option("checkpointLocation", f"{dst}/checkpoint").foreachBatch(put))
    return _means(table.read()).select("zone_id", (F.col("total") / F.col("n")).alias("difficulty"), "n")


class GatherAssembly(StatefulProcessor):
    """Holds an assembly's rows until they are as many as each of them says, then lets them all go.

    Rows are kept as Arrow files, one a batch, in the state store; of an assembly that went only its mark stays.
    """

    def __init__(self, total: str):
        self.total = total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "data binary")
        self.had = handle.getValueState("had", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.had.get()[0] if self.had.exists() else 0
        if n < 0:
            raise ValueError(f"assembly {key[0]} has more atoms than it said")
        wanted = None
        for frame in rows:
            wanted = int(frame[self.total].iloc[0])
            n += len(frame)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(frame, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.parts.appendValue((sink.getvalue().to_pybytes(),))
        if wanted is None:
            return
        if n > wanted:
            raise ValueError(f"assembly {key[0]} has more atoms than it said")
        if n == wanted:
            for (data,) in self.parts.get():
                yield pa.ipc.open_stream(data).read_all().to_pandas()
            self.parts.clear()
            n = -1
        self.had.update((n,))

    def close(self) -> None:
        pass


def stream_pick(spark: SparkSession, src: str, dst: str, pick, schema: str, files: int = 4, total: str | None = None) -> DataFrame:
    """Assemblies' atoms, as files come, through ``pick`` (atoms, unseen -> tables); an epoch's tables are one version of the store.

    ``unseen`` gives of a table with ``key`` what no earlier epoch had; what ``pick`` gives as ``novel_key`` (key) is seen by all later
    ones, so a zone is novel against everything before it. An epoch that failed half way is run again against the same keys, and rows that are stored stay.
    ``total`` names the column that says how many atoms an assembly has: its files may then come in any number of batches; it waits in
    the state store until it is whole, and is picked once. Without it an assembly must come in one batch of ``files``.
    """
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(src)
    whole = rows if total is None else rows.groupBy("assembly_id").transformWithStateInPandas(GatherAssembly(total), outputStructType=rows.schema, outputMode="Append", timeMode="None")
    seen = SeenKeys(spark, f"{dst}/seen", "key")
    arrived = SeenKeys(spark, f"{dst}/arrived", "assembly_id")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        own = batch.select("assembly_id").distinct()
        if total is None:
            again = own.join(arrived.unseen(own, epoch), "assembly_id", "left_anti").take(1)
            if again:
                raise ValueError(f"assembly {again[0].assembly_id} comes in two batches")
        if not own.isEmpty():
            tables = dict(pick(batch, lambda keys: seen.unseen(keys, epoch)))
            if "novel_key" in tables:
                seen.put(tables.pop("novel_key"), epoch)
            write_dataset(tables, f"{dst}/tables")
            if total is None:
                arrived.put(own, epoch)
        batch.unpersist()

    before = spark.conf.get(_PROVIDER, None)
    if total is not None:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        _run(whole.writeStream.option("checkpointLocation", f"{dst}/checkpoint").foreachBatch(put))
    finally:
        if total is not None:
            spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return read_table(spark, f"{dst}/tables", "zone")
