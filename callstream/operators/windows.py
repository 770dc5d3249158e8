"""Counts over sliding event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstream.functions.intervals import interval_micros
from callstream.operators.counts import PAIR
from callstream.operators.distinct import SALTS, distinct_rows
from callstream.schemas import CALL_TIME, CALL_TYPE, DISPOSITION

_TICK = "_tick"


def sliding_pair_counts(
    calls: DataFrame,
    length: str = "10 minutes",
    slide: str = "5 minutes",
    watermark: str | None = "60 minutes",
    dedup: bool = True,
    output_mode: str = "append",
    salts: int = SALTS,
) -> DataFrame:
    """Count per (window, type, disposition) of the distinct (type, disposition, time).

    ``output_mode`` is the mode the stream will be started in; batch input ignores
    it and the watermark. Complete mode keeps every window, so it takes no watermark
    and its deduplication state grows without end; append and update drop a call
    from a window only once the watermark has passed the end of that window, and
    evict the state of that window then.

    State of a stream with ``dedup``: in append mode length / slide rows per distinct
    call until its windows are past; in update and complete mode up to ``salts`` + 1
    times that (``distinct_rows``), as no aggregate may follow another there.
    """
    mode = output_mode.lower()
    bounded = calls.isStreaming and mode != "complete" and watermark is not None
    if bounded:
        calls = calls.withWatermark(CALL_TIME, watermark)
    window = F.window(CALL_TIME, length, slide).alias("window")

    if not calls.isStreaming:
        once = distinct_rows(calls, [*PAIR, CALL_TIME]) if dedup else calls
        counted = _count_by_panes(once, length, slide)
    elif not dedup:
        counted = calls.groupBy(window, *PAIR).count()
    elif not bounded:
        once = distinct_rows(calls, [*PAIR, CALL_TIME], salts)
        counted = once.groupBy(window, *PAIR).count()
    else:
        # Deduplicated per window: the key then expires with its window. The time
        # itself goes along as a number, so the window is the only event time.
        keys = ["window", *PAIR, _TICK]
        placed = calls.select(window, *PAIR, F.unix_micros(CALL_TIME).alias(_TICK))
        if mode == "append":
            # An aggregate combines copies before its shuffle; dropDuplicates does
            # not, but only append mode lets a second aggregate follow.
            once = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
        else:
            once = distinct_rows(placed, keys, salts)
        counted = once.groupBy("window", *PAIR).count()

    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *PAIR,
        "count",
    )


def _count_by_panes(calls: DataFrame, length: str, slide: str) -> DataFrame:
    """Counts per slide, summed into the windows: only the counts, not the calls,
    are repeated for each window they fall into."""
    if interval_micros(length) % interval_micros(slide):
        return calls.groupBy(F.window(CALL_TIME, length, slide).alias("window"), *PAIR).count()
    panes = calls.groupBy(F.window(CALL_TIME, slide).alias("pane"), *PAIR).count()
    window = F.window("pane.start", length, slide).alias("window")
    return panes.groupBy(window, *PAIR).agg(F.sum("count").alias("count"))


def sliding_pair_counts_by_panes(
    calls: DataFrame, length: str = "10 minutes", slide: str = "5 minutes", watermark: str = "60 minutes"
) -> DataFrame:
    """``sliding_pair_counts`` of a stream in append mode, through counts per slide.

    A call is kept once, in its pane of one ``slide``, not once per window; copies combine before
    the shuffle. Closed panes are counted, and the counts summed into windows. A call is left out
    once the watermark has passed its pane, thus out of all its windows, where the direct form
    leaves it out of those that have ended. ``length`` must be a multiple of ``slide``.
    """
    if interval_micros(length) % interval_micros(slide):
        raise ValueError("the length of the windows must be a multiple of their slide")
    late = calls.withWatermark(CALL_TIME, watermark)
    pane = F.window(CALL_TIME, slide).alias("pane")
    placed = late.select(pane, *PAIR, F.unix_micros(CALL_TIME).alias(_TICK))
    once = placed.groupBy("pane", *PAIR, _TICK).agg(F.count(F.lit(1)).alias("_copies"))
    panes = once.groupBy("pane", *PAIR).agg(F.count(F.lit(1)).alias("_calls"))
    return _summed(panes, PAIR, F.sum("_calls").alias("count"), length, slide)


def sliding_type_estimates(
    calls: DataFrame,
    length: str = "10 minutes",
    slide: str = "5 minutes",
    watermark: str = "60 minutes",
    log_size: int = 12,
) -> DataFrame:
    """How many call types each (window, disposition) has, estimated by theta sketches.

    A sketch per slide, merged into the windows: neither the state nor the shuffle holds the
    types. Exact up to 2 ** ``log_size`` types of a window; beyond, the standard error is
    1 / sqrt(2 ** log_size), 1.6 % by default. A stream runs in append mode and drops calls by
    pane, as in ``sliding_pair_counts_by_panes``.
    """
    if interval_micros(length) % interval_micros(slide):
        raise ValueError("the length of the windows must be a multiple of their slide")
    if calls.isStreaming:
        calls = calls.withWatermark(CALL_TIME, watermark)
    pane = F.window(CALL_TIME, slide).alias("pane")
    sketch = F.theta_sketch_agg(CALL_TYPE, log_size).alias("_sketch")
    panes = calls.groupBy(pane, DISPOSITION).agg(sketch)
    merged = F.theta_union_agg("_sketch", log_size)
    estimate = F.theta_sketch_estimate(merged).alias("types")
    return _summed(panes, [DISPOSITION], estimate, length, slide)


def _summed(panes: DataFrame, keys: list[str], value: Column, length: str, slide: str) -> DataFrame:
    """An aggregate over the panes that make up each window."""
    window = F.window(F.window_time("pane"), length, slide).alias("window")
    found = panes.groupBy(window, *keys).agg(value)
    return found.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *found.columns[1:]
    )
