"""Matching of arriving records against a reference table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, fellegi_sunter
from ..spec import BlockingRule


def match_stream(arriving: DataFrame, reference: DataFrame, rules: list[BlockingRule], model: fellegi_sunter.Model, threshold: float, out: str, checkpoint: str) -> StreamingQuery:
    """Scored pairs (arriving record left, reference record right) as Parquet, a folder
    for each micro-batch that a repeated batch replaces, so each pair is written once."""

    def each(batch: DataFrame, number: int) -> None:
        candidates = blocking.rule_pairs(batch, reference, rules)
        scored = fellegi_sunter.predict(candidates, batch, reference, model, threshold)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
