"""Encode and score applications as they arrive.

Encoding and scoring look at one row at a time once the state is fitted, so the
batch operators run unchanged on a streaming DataFrame. The tables of the encoder
join as the static side: broadcast when small, else in a shuffle of each batch
with the categories that were frequent in the fit served by a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from riskframe.functions.scorecard import Scorecard
from riskframe.operators.features import FeatureEncoderModel
from riskframe.operators.learn import FittedFlow


def encode_stream(
    stream: DataFrame, encoder: FeatureEncoderModel, keep: Sequence[str] | None = None
) -> DataFrame:
    return encoder.encode(stream, keep)


def score_stream(
    stream: DataFrame, scorer: Scorecard | FittedFlow, keep: Sequence[str], out: str = "score"
) -> DataFrame:
    """``keep`` columns and the score of every arriving row."""
    if isinstance(scorer, FittedFlow):
        return scorer.score(stream, keep, out)
    return scorer.score(stream, out).select(*keep, out)


def append_to(
    scored: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write the scored stream to Parquet; both folders must be shared storage."""
    writer = (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
