"""Ordered folds over events per key: debouncing, run coalescing, sliding-log limits. Batch forms of the stream operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import prefix

#: The index's own ignore and configuration files; pass others where an installation names them otherwise.
OWN_RULE_FILES = (".indexignore", ".indexconfig.yaml")

# Names, extensions and basenames that a watcher leaves out.
EXCLUDED_DIRS = frozenset("node_modules .git .venv __pycache__ dist build .next .cache .DS_Store .idea .vscode vendor target .svn .hg coverage .nyc_output .tox .eggs .gradle .mvn".split())
EXCLUDED_EXTENSIONS = frozenset(".pyc .pyo .class .o .obj .exe .dll .so .dylib .a .lib .jpg .jpeg .png .gif .ico .svg .mp3 .mp4 .avi .mov .wav .zip .tar .gz .rar .7z .lock .sum .swp .swx .swo .tmp .bak".split())
RULE_FILES = frozenset((".gitignore", *OWN_RULE_FILES))


def action(rel_path: Column, rule_files: frozenset[str] = RULE_FILES) -> Column:
    """What a changed path asks for: immediate (the head of the repository moved), full (ignore rules changed), track or
    drop (excluded directories, temporary files, binary extensions)."""
    parts = F.split(rel_path, "/")
    base = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    excluded = F.arrays_overlap(dirs, F.array(*map(F.lit, sorted(EXCLUDED_DIRS)))) | F.exists(dirs, lambda d: F.endswith(d, F.lit(".egg-info")))
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    temporary = F.endswith(base, F.lit("~")) | F.startswith(base, F.lit(".#")) | (base == "4913")
    return (
        F.when(rel_path == ".git/HEAD", "immediate").when(excluded, "drop").when(base.isin(*sorted(rule_files)), "full").when(temporary | ext.isin(*sorted(EXCLUDED_EXTENSIONS)), "drop").otherwise("track")
    )


def debounce(events: DataFrame, key: str, at: str, path: str, gap_seconds: float) -> DataFrame:
    """(key, first, last, paths): sessions of events with gaps under ``gap_seconds`` between them, with their distinct
    paths. Gaps are found and numbered in two levels, so that a key with most of the events is many tasks; a session is an
    array of its distinct paths."""
    e = events.where(F.col(at).isNotNull()).withColumn("_us", F.unix_micros(F.col(at)))
    e = prefix.segmented(e, [key], "_us", gap_seconds * 1_000_000, "_s").drop("_us")
    return e.groupBy(key, "_s").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"), F.array_sort(F.collect_set(path)).alias("paths")).drop("_s")


def _fold(events: DataFrame, key: str, order: list[str], make, step, finish, schema: str, reset: float) -> DataFrame:
    """An ordered fold of each key's rows in bounded memory: rows are sorted within partitions and flow through in
    batches; only the state of the segment at hand is kept.

    After a gap of ``reset`` seconds or more between two rows of a key the state is as at the beginning, so that the
    key is cut there (``prefix.segmented``) and its segments are folded in different tasks. What is one segment, rows
    without such a gap, is inherently ordered and stays one task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for k, seg, *r in zip(cols[0], cols[1], *cols[2:]):
                if state is None or (k, seg) != current:
                    if state is not None:
                        out += finish(current[0], state)
                    current, state = (k, seg), make()
                out += step(k, state, *r)
            if len(out) > 10_000:
                yield batch()
                out = []
        if state is not None:
            out += finish(current[0], state)
        yield batch()

    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    target = events.sparkSession.createDataFrame([], schema).schema
    types = [to_arrow_type(f.dataType) for f in target.fields]
    e = prefix.segmented(events, [key], "t", reset, "_seg") if reset < float("inf") else events.withColumn("_seg", F.lit(1))
    e = e.select(key, "_seg", *(c for c in events.columns if c != key))
    return e.repartition(key, "_seg").sortWithinPartitions(key, "_seg", *order).mapInArrow(run, target)


def debounce_capped(events: DataFrame, key: str, gap_seconds: float, cap_factor: int = 10) -> DataFrame:
    """(key, flushed_at, events, paths): debouncing with a cap. Columns of events: key, t (seconds), path.

    A flush comes ``gap_seconds`` after the last event, or with the first event at least ``cap_factor`` gaps after the
    session's first one (that event belongs to the flush). Rows with a null time or key are ignored.
    """
    e = events.where(F.col("t").isNotNull() & F.col(key).isNotNull()).select(key, F.col("t").cast("double").alias("t"), "path")

    def step(k, s, t, path):
        out = []
        if s["n"] and t - s["last"] >= gap_seconds:
            out.append((k, s["last"] + gap_seconds, s["n"], ",".join(sorted(s["paths"]))))
            s.update(first=None, n=0, paths=set())
        if not s["n"]:
            s["first"] = t
        s["n"] += 1
        s["last"] = t
        s["paths"].add(path or "")
        if t - s["first"] >= cap_factor * gap_seconds:
            out.append((k, t, s["n"], ",".join(sorted(s["paths"]))))
            s.update(first=None, n=0, paths=set())
        return out

    finish = lambda k, s: [(k, s["last"] + gap_seconds, s["n"], ",".join(sorted(s["paths"])))] if s["n"] else []
    kind = events.schema[key].dataType.simpleString()
    return _fold(e, key, ["t", "path"], lambda: {"first": None, "last": 0.0, "n": 0, "paths": set()}, step, finish, f"{key} {kind}, flushed_at double, events int, paths string", gap_seconds)


def coalesce_runs(requests: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, started_at, full, requests): one run at a time, each of ``seconds``; requests during a run become one
    follow-up, which is full if any of them is. Columns of requests: key, t (seconds), full."""
    e = requests.where(F.col("t").isNotNull() & F.col(key).isNotNull()).select(key, F.col("t").cast("double").alias("t"), F.coalesce("full", F.lit(False)).alias("full"))

    def due(k, s, now):
        out = []
        while s["end"] is not None and s["end"] <= now:
            if s["n"]:
                out.append((k, s["end"], s["full"], s["n"]))
                s.update(end=s["end"] + seconds, n=0, full=False)
            else:
                s["end"] = None
        return out

    def step(k, s, t, full):
        out = due(k, s, t)
        if s["end"] is None:
            s["end"] = t + seconds
            return [*out, (k, t, bool(full), 1)]
        s["n"] += 1
        s["full"] = s["full"] or bool(full)
        return out

    kind = requests.schema[key].dataType.simpleString()
    return _fold(e, key, ["t", "full"], lambda: {"end": None, "n": 0, "full": False}, step, lambda k, s: due(k, s, float("inf")) if s["n"] else [], f"{key} {kind}, started_at double, full boolean, requests int", 2 * seconds)  # one run and its follow-up


def sliding_log(attempts: DataFrame, key: str, limit: int, window_seconds: float) -> DataFrame:
    """(key, attempt_id, t, allowed, retry_after): at most ``limit`` allowed attempts in any window; attempts that are not
    allowed are not recorded; retry_after is what the oldest recorded one has left, at least a second. Columns: key,
    attempt_id, t (seconds). The state is the last ``limit`` allowed times."""
    e = attempts.where(F.col("t").isNotNull() & F.col(key).isNotNull()).select(key, "attempt_id", F.col("t").cast("double").alias("t"))

    def step(k, s, attempt, t):
        kept = s["kept"]
        while kept and kept[0] < t - window_seconds:
            kept.pop(0)
        if len(kept) >= limit:
            return [(k, attempt, t, False, max(window_seconds - (t - kept[0]), 1.0))]
        kept.append(t)
        return [(k, attempt, t, True, 0.0)]

    kind = attempts.schema[key].dataType.simpleString()
    aid = attempts.schema["attempt_id"].dataType.simpleString()
    return _fold(e, key, ["t", "attempt_id"], lambda: {"kept": []}, step, lambda k, s: [], f"{key} {kind}, attempt_id {aid}, t double, allowed boolean, retry_after double", window_seconds + 1e-6)  # an attempt exactly a window old still counts


# Attempts and seconds of the two windows of a login limiter; restarts, seconds and first delay of a restart budget.
LOGIN_LIMITS = ((5, 900.0), (60, 60.0))
RESTARTS = (3, 300.0)


def login_limits(attempts: DataFrame, pair: tuple[int, float] = LOGIN_LIMITS[0], address: tuple[int, float] = LOGIN_LIMITS[1]) -> DataFrame:
    """(address, attempt_id, t, allowed, retry_after) of attempts (attempt_id, address, email, t, success).

    Two sliding logs: one of an address and one of an address with an account. An attempt is allowed if neither is full,
    the address's first; only allowed ones are recorded, in both; an allowed attempt that succeeds clears the log of its
    pair and leaves the address's. retry_after is what the oldest attempt of the full log has left, at least a second.
    Emails are compared trimmed and in lower case. The state of an address is bounded by what its log may hold.
    """
    (n_pair, w_pair), (n_address, w_address) = pair, address
    e = attempts.where(F.col("t").isNotNull() & F.col("address").isNotNull()).select("address", "attempt_id", F.col("t").cast("double").alias("t"), F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("email"), F.coalesce("success", F.lit(False)).alias("success"))

    def full(log: list[float], t: float, window: float, most: int) -> float | None:
        while log and log[0] < t - window:
            log.pop(0)
        return max(window - (t - log[0]), 1.0) if len(log) >= most else None

    def step(k, s, attempt, t, email, success):
        wait = full(s["address"], t, w_address, n_address)
        if wait is None:
            log = s["pairs"].setdefault(email, [])
            wait = full(log, t, w_pair, n_pair)
        if wait is not None:
            return [(k, attempt, t, False, wait)]
        s["address"].append(t)
        log.append(t)
        if success:
            del s["pairs"][email]
        if len(s["pairs"]) > 4 * n_address:  # logs that have run out say nothing
            s["pairs"] = {x: v for x, v in s["pairs"].items() if v and v[-1] >= t - w_pair}
        return [(k, attempt, t, True, 0.0)]

    aid = attempts.schema["attempt_id"].dataType.simpleString()
    kind = attempts.schema["address"].dataType.simpleString()
    schema = f"address {kind}, attempt_id {aid}, t double, allowed boolean, retry_after double"
    return _fold(e, "address", ["t", "attempt_id"], lambda: {"address": [], "pairs": {}}, step, lambda k, s: [], schema, max(w_pair, w_address) + 1e-6)


def restart_budget(failures: DataFrame, key: str, most: int = RESTARTS[0], window: float = RESTARTS[1]) -> DataFrame:
    """(key, failure_id, t, attempt, backoff, dead) of failures (key, failure_id, t): every failure counts as an attempt
    among those less than ``window`` seconds old; attempt n waits 2^(n-1) seconds; one beyond ``most`` is dead, and so is
    everything after it."""
    e = failures.where(F.col("t").isNotNull() & F.col(key).isNotNull()).select(key, "failure_id", F.col("t").cast("double").alias("t"))

    def step(k, s, failure, t):
        if s["dead"]:
            return [(k, failure, t, None, None, True)]
        s["at"] = [x for x in s["at"] if x > t - window] + [t]
        n = len(s["at"])
        s["dead"] = n > most
        return [(k, failure, t, n, None if s["dead"] else float(2 ** (n - 1)), s["dead"])]

    fid = failures.schema["failure_id"].dataType.simpleString()
    kind = failures.schema[key].dataType.simpleString()
    # a dead key stays dead, so that nothing resets it: its failures are one segment
    return _fold(e, key, ["t", "failure_id"], lambda: {"at": [], "dead": False}, step, lambda k, s: [], f"{key} {kind}, failure_id {fid}, t double, attempt int, backoff double, dead boolean", float("inf"))


def debounce_routed(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """(key, at, kind, events, paths): debouncing of routed events (key, t, path, action). Tracked paths wait for a gap of
    ``gap_seconds`` (kind incremental); an immediate or full event flushes at once as a run of its own kind, and what was
    pending is dropped, as that run sees it too; dropped events count for nothing."""
    e = events.where(F.col("t").isNotNull() & F.col(key).isNotNull() & (F.col("action") != "drop")).select(key, F.col("t").cast("double").alias("t"), "path", "action")

    def step(k, s, t, path, action):
        out = []
        if s["n"] and t - s["last"] >= gap_seconds:
            out.append((k, s["last"] + gap_seconds, "incremental", s["n"], ",".join(sorted(s["paths"]))))
            s.update(n=0, paths=set())
        if action != "track":
            s.update(n=0, paths=set())
            return [*out, (k, t, action, 1, path)]
        s["n"] += 1
        s["last"] = t
        s["paths"].add(path or "")
        return out

    finish = lambda k, s: [(k, s["last"] + gap_seconds, "incremental", s["n"], ",".join(sorted(s["paths"])))] if s["n"] else []
    kind = events.schema[key].dataType.simpleString()
    return _fold(e, key, ["t", "action", "path"], lambda: {"last": 0.0, "n": 0, "paths": set()}, step, finish, f"{key} {kind}, at double, kind string, events int, paths string", gap_seconds)


def heartbeats(lines: DataFrame, key: str, every: float = 10.0) -> DataFrame:
    """(key, t): the heartbeats that a progress stream sends, every ``every`` seconds after a line that no other follows by
    then. Columns of lines: key, t (seconds)."""
    o = prefix.ordered(lines.where(F.col("t").isNotNull()).select(key, F.col("t").cast("double").alias("t")).distinct(), [key], ["t"])
    o = prefix.before(o, [key], [("_last", F.max("t"))], F.max)
    o = o.withColumn("_from", F.coalesce(F.lag("t").over(prefix.inside([key], ["t"])), F.col("_last"))).where("_from is not null")
    n = F.ceil((F.col("t") - F.col("_from")) / every).cast("int") - 1
    return o.where(n >= 1).select(key, F.col("_from"), F.explode(F.sequence(F.lit(1), n)).alias("_i")).select(key, (F.col("_from") + F.col("_i") * every).alias("t"))


def idle_aborts(lines: DataFrame, key: str, limit: float) -> DataFrame:
    """(key, t): where a reader gives a stream up, ``limit`` seconds after the first line that no other follows by then,
    if lines come later at all. One row per key at most."""
    o = prefix.ordered(lines.where(F.col("t").isNotNull()).select(key, F.col("t").cast("double").alias("t")).distinct(), [key], ["t"])
    o = prefix.before(o, [key], [("_last", F.max("t"))], F.max)
    o = o.withColumn("_from", F.coalesce(F.lag("t").over(prefix.inside([key], ["t"])), F.col("_last")))
    return o.where(F.col("t") - F.col("_from") > limit).groupBy(key).agg((F.min("_from") + limit).alias("t"))


def sync_ticks(spans: DataFrame, key: str, every: float = 120.0) -> DataFrame:
    """(key, t): periodic full comparisons while a watcher runs: one at its start and one every ``every`` seconds. Columns of
    spans: key, begin, end (seconds)."""
    n = F.floor((F.col("end") - F.col("begin")) / every).cast("int")
    return spans.where("begin <= end").select(key, "begin", F.explode(F.sequence(F.lit(0), n)).alias("_i")).select(key, (F.col("begin") + F.col("_i") * every).alias("t"))
