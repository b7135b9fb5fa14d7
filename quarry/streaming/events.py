"""Streams of events: windows, alerts once a key, numbered events of a key, and a scrubber of spans that cross messages.

Each function takes a streaming or a batch DataFrame; where state is needed, keys are the partitions of the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows (an extension: nothing in the survey has windows by event time)."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def once(events: DataFrame, keys: list[str], ttl: str = "30 days") -> DataFrame:
    """The first event of each key within the time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def numbered(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events with a number that goes on within each key from batch to batch, in the order of arrival, then time, then id."""
    schema = T.StructType([*events.schema.fields, T.StructField("sequence", T.LongType())])

    def number(_: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        rows["sequence"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows

    return events.groupBy(key).applyInPandasWithState(number, schema, "last long", "append", GroupStateTimeout.NoTimeout)


#: Spans that must not reach a reader, opening and closing tag.
TAGS = {"<memory-context>": "</memory-context>", "<think>": "</think>", "<thinking>": "</thinking>", "<reasoning>": "</reasoning>"}


def scrub(piece: str, inside: str, held: str) -> tuple[str, str, str]:
    """What may be shown of the text so far, the closing tag awaited, and what is held back since it may begin a tag."""
    text, out = held + piece, []
    while text:
        if inside:
            at = text.find(inside)
            if at < 0:
                keep = next((n for n in range(min(len(inside) - 1, len(text)), 0, -1) if inside.startswith(text[-n:])), 0)
                return "".join(out), inside, text[len(text) - keep :]
            text, inside = text[at + len(inside) :], ""
            continue
        found = [(at, tag) for tag in TAGS if (at := text.find(tag)) >= 0]
        if not found:
            keep = next((n for n in range(min(max(map(len, TAGS)) - 1, len(text)), 0, -1) if any(t.startswith(text[-n:]) for t in TAGS)), 0)
            out.append(text[: len(text) - keep])
            return "".join(out), "", text[len(text) - keep :]
        at, tag = min(found)
        out.append(text[:at])
        text, inside = text[at + len(tag) :], TAGS[tag]
    return "".join(out), inside, ""


def scrubbed(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each message's visible text where spans may begin in one message and end in a later one; state is kept for each key."""
    schema = T.StructType([messages.schema[key], messages.schema[order], T.StructField("visible", T.StringType())])

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, held = state.get if state.exists else ("", "")
        rows = pd.concat(list(parts)).sort_values(order)
        shown = []
        for piece in rows[text].fillna(""):
            seen, inside, held = scrub(piece, inside, held)
            shown.append(seen)
        state.update((inside, held))
        yield pd.DataFrame({key: rows[key], order: rows[order], "visible": shown})

    return messages.groupBy(key).applyInPandasWithState(run, schema, "inside string, held string", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through an in-memory sink."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
