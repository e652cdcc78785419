"""An indexing run over the index's tables: begin, batches, finish, cancel, and what is shown of it.

The index is a mapping of tables: ``hashes`` (project_path, path, content_hash), ``chunks``, ``symbols`` and ``refs`` (each
with project_path and path). Every step returns new DataFrames; commit them with ``ingest.commit_version``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingest, symbols as names

Index = dict[str, DataFrame]
_FILE = ["project_path", "path"]


def begin(index: Index, runs: DataFrame, project: str, run_id: str, at: Column, full: bool = False) -> tuple[Index, DataFrame, DataFrame]:
    """(index, runs, stored hashes) after a run of a project has begun. A full run wipes the project's rows of every table
    and has no stored hashes; an incremental one returns those of the project. The run is added as running; while the
    project has a running one, a ValueError says so."""
    if not runs.where((F.col("project_path") == project) & (F.col("status") == "running")).isEmpty():
        raise ValueError(f"a run of {project} is active")
    row = runs.sparkSession.createDataFrame([(run_id, project)], "run_id string, project_path string").select("run_id", "project_path", F.lit("running").alias("status"), at.alias("started_at"))
    stored = index["hashes"].where(F.col("project_path") == project)
    if full:
        index = {n: t.where(F.col("project_path") != project) for n, t in index.items()}
        stored = stored.limit(0)
    return index, ingest.append(runs, row), stored.select("path", "content_hash")


def process(index: Index, files: DataFrame, chunks: DataFrame, symbols: DataFrame, refs: DataFrame) -> Index:
    """The index after a batch of files (project_path, path, content_hash): the rows of these files are replaced in every
    table by the given ones. Files that are blank or too large (``ingest.indexable``) are to be left out before, so that
    their old rows stay."""
    done = files.select(*_FILE).distinct()
    out = {"hashes": ingest.upsert(index["hashes"], files.select(*_FILE, "content_hash"), _FILE)}
    for n, rows in (("chunks", chunks), ("symbols", symbols), ("refs", refs)):
        out[n] = ingest.append(ingest.delete_keys(index[n], done, _FILE), rows.join(done, _FILE, "left_semi"))
    return index | out


def finish(index: Index, gone: DataFrame) -> tuple[Index, DataFrame]:
    """(index, stats) after a run: rows of the deleted paths (project_path, path) leave every table, and each project has
    its numbers of files, chunks and symbols and its languages anew."""
    index = {n: ingest.delete_keys(t, gone.select(*_FILE).distinct(), _FILE) for n, t in index.items()}
    files = index["hashes"].groupBy("project_path").agg(F.count("*").alias("indexed_files"))
    per = lambda n, c: index[n].groupBy("project_path").agg(F.count("*").alias(c))
    stats = files.join(per("chunks", "total_chunks"), "project_path", "left").join(per("symbols", "total_symbols"), "project_path", "left")
    stats = stats.fillna(0, ["total_chunks", "total_symbols"]).join(ingest.languages_of(index["hashes"]), "project_path", "left")
    return index, stats


def ended(runs: DataFrame, ids: DataFrame, status: str = "completed") -> DataFrame:
    """The runs with those of ``ids`` (run_id) that are running set to a final status (completed, cancelled)."""
    hit = ids.select(F.col("run_id").alias("_r")).distinct()
    j = runs.join(hit, F.col("run_id") == F.col("_r"), "left")
    now = F.when(F.col("_r").isNotNull() & (F.col("status") == "running"), status).otherwise(F.col("status"))
    return j.withColumn("status", now).drop("_r")


def shown_status(status: Column) -> Column:
    """A session's status as it is shown: an active one is indexing."""
    return F.when(status == "active", "indexing").otherwise(status)


def index_status(projects: DataFrame, sessions: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(project_path, status, run_id, files_processed, chunks_created, elapsed_seconds): the progress of the project's live
    session, else its last run's, else idle. Of several sessions the latest counts. Elapsed seconds have one decimal and
    only a live session has them."""
    pick = lambda d, at, *fields: d.groupBy("project_path").agg(F.max_by(F.struct(*fields), F.struct(at, "run_id")).alias("x"))
    live = pick(sessions, "started_at", "run_id", shown_status(F.col("status")).alias("status"), "files_processed", "chunks_created", "started_at").select("project_path", F.col("x").alias("_live"))
    last = pick(runs, "started_at", "run_id", "status", "files_processed", "chunks_created").select("project_path", F.col("x").alias("_run"))
    j = projects.select("project_path").join(live, "project_path", "left").join(last, "project_path", "left")
    of = lambda c: F.coalesce(F.col(f"_live.{c}"), F.when(F.col("_live").isNull(), F.col(f"_run.{c}")))
    elapsed = F.floor((F.unix_micros(now) - F.unix_micros(F.col("_live.started_at"))) / 1e5 + 0.5) / 10
    return j.select("project_path", F.coalesce(of("status"), F.lit("idle")).alias("status"), of("run_id").alias("run_id"), of("files_processed").alias("files_processed"), of("chunks_created").alias("chunks_created"), elapsed.alias("elapsed_seconds"))


def server_status(projects: DataFrame, runs: DataFrame, model_ready: bool) -> DataFrame:
    """(projects, running, model_ready): one row of counts."""
    p = projects.agg(F.count("*").alias("projects"))
    r = runs.agg(F.count_if(F.col("status") == "running").alias("running"))
    return p.crossJoin(r).withColumn("model_ready", F.lit(model_ready))  # one row each


def live_sessions(sessions: DataFrame, now: Column, active_seconds: int = 3600, done_seconds: int = 60) -> DataFrame:
    """The sessions that have not run out: an active one an hour after it began, a finished one a minute after its end."""
    age = lambda c: F.unix_micros(now) - F.unix_micros(F.col(c))
    return sessions.where(F.when(F.col("status") == "active", age("started_at") < active_seconds * 1_000_000).otherwise(age("ended_at") < done_seconds * 1_000_000))


def project_details(projects: DataFrame, files: DataFrame, symbols: DataFrame, dirs: int = 10, most: int = 20) -> DataFrame:
    """(project_path, status, languages, total_files, total_symbols, top_directories, recent_symbols) of every project: the
    ``dirs`` directories with most files and ``most`` symbols in order of file, line, name, each as an array. The arrays are
    cut before they are made."""
    top = ingest.directory_histogram(files, keys=["project_path"], n=dirs)
    top = top.groupBy("project_path").agg(F.array_sort(F.collect_list(F.struct((-F.col("file_count")).alias("o"), F.col("dir").alias("path"), F.col("file_count").alias("files")))).alias("x"))
    top = top.select("project_path", F.transform("x", lambda x: F.struct(x["path"].alias("path"), x["files"].alias("files"))).alias("top_directories"))
    some = names.first_symbols(symbols, most).groupBy("project_path").agg(F.array_sort(F.collect_list(F.struct("file_path", "line", "name", "kind"))).alias("recent_symbols"))
    n = files.groupBy("project_path").agg(F.count("*").alias("total_files"))
    m = symbols.groupBy("project_path").agg(F.count("*").alias("total_symbols"))
    j = projects.select(F.col("host_path").alias("project_path"), "status", F.coalesce("languages", F.lit("[]")).alias("languages"))
    for t in (n, m, top, some):
        j = j.join(t, "project_path", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c)
    return j.fillna(0, ["total_files", "total_symbols"]).select("project_path", "status", "languages", "total_files", "total_symbols", empty("top_directories"), empty("recent_symbols"))
