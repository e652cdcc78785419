"""Structured Streaming forms: change events, debouncing with state, progress events as NDJSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import folds

PROGRESS = (
    "event string, path string, file_index int, batch_size int, chunks int, embed_ms bigint, ts string, message string, fatal boolean, "
    "files_accepted int, chunks_created int, files_processed_total int, run_id string"
)
TERMINAL = ("batch_done", "error")


def routed(events: DataFrame, path: str = "path") -> DataFrame:
    """Change events with their action; dropped ones are left out."""
    return events.withColumn("action", folds.action(F.col(path))).where("action <> 'drop'")


def session_debounce(events: DataFrame, key: str, at: str, path: str, gap: str = "5 seconds", late: str = "1 hour") -> DataFrame:
    """(key, first, last, paths) of each session, on a stream or a table; a session is emitted when the watermark passes
    its end. Late events beyond ``late`` are dropped (an addition: the watched source has no event time)."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.array_sort(F.collect_set(path)).alias("paths"))
    return g.select(key, "first", "last", "paths")


def capped_debounce(events: DataFrame, key: str, gap_seconds: float = 5.0, cap_factor: int = 10) -> DataFrame:
    """Stateful debouncing of a stream with a cap on waiting: (key, flushed_at, events, paths).

    State per key: first and last time, number and distinct paths of the open session; a processing-time timer flushes it
    when no event comes within the gap. Columns of events: key, t (seconds), path.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, paths = state.get if state.exists else (0.0, 0.0, 0, "")
        seen = set(paths.split("\n")) - {""}
        out = []
        if state.hasTimedOut:
            out.append((k[0], last + gap_seconds, n, ",".join(sorted(seen))))
            state.remove()
        else:
            rows = sorted((float(t), str(p)) for pdf in batches for t, p in zip(pdf["t"], pdf["path"]))
            for t, p in rows:
                if n and t - last >= gap_seconds:
                    out.append((k[0], last + gap_seconds, n, ",".join(sorted(seen))))
                    n, seen = 0, set()
                if not n:
                    first = t
                n, last = n + 1, t
                seen.add(p)
                if t - first >= cap_factor * gap_seconds:
                    out.append((k[0], t, n, ",".join(sorted(seen))))
                    n, seen = 0, set()
            if n:
                state.update((first, last, n, "\n".join(sorted(seen))))
                state.setTimeoutDuration(int(gap_seconds * 1000))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[key, "flushed_at", "events", "paths"])

    schema = f"{key} {kind}, flushed_at double, events int, paths string"
    return events.groupBy(key).applyInPandasWithState(run, schema, "first double, last double, n int, paths string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def change_source(spark, folder: str) -> DataFrame:
    """A stream of change events (at, path, kind) from a folder to which a watcher adds NDJSON files."""
    return spark.readStream.schema("at timestamp, path string, kind string").json(folder)


def progress_source(spark, folder: str) -> DataFrame:
    """A stream of progress events from a folder of NDJSON files."""
    return parse_progress(spark.readStream.text(folder))


def progress_sink(events: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Write a stream of progress events as NDJSON, one line per event; ``every`` is the trigger's interval (such as
    "10 seconds"), without it what is there is written once. The started query is returned."""
    w = to_progress(events).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


# Bytes of the longest line that a reader takes.
MAX_LINE = 1 << 20


def parse_progress(lines: DataFrame, value: str = "value", most: int = MAX_LINE) -> DataFrame:
    """NDJSON progress lines as columns; lines that are no JSON, or longer than ``most`` bytes, have a null event."""
    short = F.when(F.octet_length(value) <= most, F.col(value))
    return lines.select(F.from_json(short, PROGRESS).alias("e")).select("e.*")


def to_progress(events: DataFrame) -> DataFrame:
    """One NDJSON line per event; absent, zero, false and empty fields are left out."""
    fields = []
    for f in events.schema.fields:
        c = F.col(f.name)
        t = f.dataType.simpleString()
        blank = c == "" if t == "string" else ~c if t == "boolean" else c == 0
        fields.append((c if f.name == "event" else F.when(blank, None).otherwise(c)).alias(f.name))
    return events.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def terminal_of(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Each run's terminal events."""
    return events.where(F.col("event").isin(*TERMINAL)).groupBy(key).agg(F.count("*").alias("terminals"), F.max("event").alias("event"))


def outcome_of(events: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, lines, outcome): done, failed or, where a stream ends without a terminal event or with more than one, broken."""
    is_end = F.col("event").isin(*TERMINAL)
    g = events.groupBy(key).agg(F.count("event").alias("lines"), F.count_if(is_end).alias("_n"), F.max(F.when(is_end, F.col("event"))).alias("_e"))
    return g.select(key, "lines", F.when(F.col("_n") != 1, "broken").when(F.col("_e") == "error", "failed").otherwise("done").alias("outcome"))
