"""Features and scores of flows as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.packets import flow_id
from tidewire.functions.scalar import is_dns
from tidewire.operators import report as R
from tidewire.operators.explain import explain as explain_rows
from tidewire.operators.features import features_of_sums
from tidewire.operators.flows import FlowRules, flow_ends
from tidewire.operators.model import Trained, predict
from tidewire.schemas import MIN_PACKETS
from tidewire.streaming.flows import DEFAULT_DELAY, assign_flow_stream


def closed_features(closed: DataFrame, min_packets: int = MIN_PACKETS) -> DataFrame:
    """Features of closed flows from the sums they bring along, by the definitions of the batch code; no packet is read."""
    flows = closed.filter(F.col("total_packets") >= min_packets).withColumns({
        **flow_ends(), "flow_id": flow_id(), "duration_s": F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0)) / F.lit(1e6),
        "dns_query_entropy": F.when(is_dns(F.col("lo_port"), F.col("hi_port")), F.col("dns_query_entropy")).otherwise(0.0)})
    return features_of_sums(flows)


def score_stream(
    spark: SparkSession, packets: DataFrame, trained: Trained, path: str, rules: FlowRules = FlowRules(),
    min_packets: int = MIN_PACKETS, delay: str = DEFAULT_DELAY, explain: bool = False,
    every: str | None = None,
):
    """Starts the query (what has landed, or on and on with a batch `every` so often): `<path>/alerts` gets the scored closed flows.

    Each micro-batch overwrites its own folder, so a batch that is run again leaves no doubles. Packets are not kept.
    """
    def on_batch(batch: DataFrame, number: int) -> None:
        scored = predict(trained, closed_features(batch, min_packets))
        found = R.detections(explain_rows(trained, scored) if explain else scored)
        found.write.mode("overwrite").parquet(f"{path}/alerts/epoch={number}")

    return (
        assign_flow_stream(packets, rules, delay, with_packets=False).writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    )
