"""A growing summary over a stream of long event rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.views import View, keyed


def running_sums(stream: DataFrame, view: View) -> DataFrame:
    """The view's aggregate as a streaming frame; state holds one row for each key."""
    return view.kept(stream).groupBy(*keyed(view.aggregate)).agg(F.sum("tsc").alias("tsc"), F.sum("value").alias("value"))


def windowed_rates(stream: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Counts and ticks of each event by tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "name").agg(F.sum("tsc").alias("tsc"), F.sum("value").alias("value"))


def replay(stream: DataFrame, view: View, each: Callable[[DataFrame, int], None], refresh: str = "1 second") -> StreamingQuery:
    """Call each with the running sums after every trigger."""
    return running_sums(stream, view).writeStream.outputMode("complete").trigger(processingTime=refresh).foreachBatch(each).start()
