"""Live courier positions: every trigger's telemetry is put into the log and into one row a courier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from frota.operators.latest import latest_per_key
from frota.sources.snapshots import Snapshots
from frota.streaming.fleet import TABLES


def position_state(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, folder, {name: TABLES[name] for name in ("telemetria", "posicoes")})


def put_positions(state: Snapshots, telemetry: DataFrame, version: int) -> None:
    """A row with the courier and time of an earlier one replaces it; an older row never moves a courier back.

    Of equal times in one trigger the one with the greater ``write_seq`` counts, or the greater coordinates if there is none.
    """
    written = [F.col("write_seq")] if "write_seq" in telemetry.columns else []
    rows = telemetry.withColumn("_last", F.struct(*written, "latitude", "longitude"))
    batch = state.begin(version)
    batch.put("telemetria", rows, "_last")
    # the log's rows of this trigger, once a courier and time
    fresh = state.gathered("telemetria", [batch.folders["telemetria"][-1]])
    batch.put("posicoes", latest_per_key(fresh.select("id_entregador", "ts", "latitude", "longitude"), ["id_entregador"], ["ts"]))
    batch.commit()


def run_positions(telemetry: DataFrame, state: Snapshots, checkpoint: str, **trigger) -> StreamingQuery:
    def step(batch: DataFrame, batch_id: int) -> None:
        if state.version() < batch_id:
            put_positions(state, batch, batch_id)

    writer = telemetry.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(step).start()
