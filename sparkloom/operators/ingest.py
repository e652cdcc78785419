"""Keeping an index current: differences by hash, upserts, deletes, runs and statistics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import file_system
from . import prefix

# The largest content that is indexed, and the files of a batch where no number is given and at most.
MAX_CONTENT = 524_288
DEFAULT_BATCH = 5
MAX_BATCH = 50


def hash_diff(discovered: DataFrame, stored: DataFrame, keys: Sequence[str] = ("path",), hash_col: str = "content_hash", full: bool = False) -> DataFrame:
    """(keys, status): new, changed, unchanged or deleted, from one full outer join on the keys.

    A stored null hash counts as changed. With ``full`` all discovered files are to be sent (status changed or new) and
    nothing is deleted. Null keys never match. Both sides need distinct keys.
    """
    d = discovered.select(*keys, F.col(hash_col).alias("_d"), F.lit(True).alias("_in_d"))
    s = stored.select(*keys, F.col(hash_col).alias("_s"), F.lit(True).alias("_in_s"))
    j = d.join(s, list(keys), "full_outer")
    same = F.coalesce(F.col("_d") == F.col("_s"), F.lit(False)) & F.lit(not full)
    status = F.when(F.col("_in_d").isNull(), "deleted").when(F.col("_in_s").isNull(), "new").when(same, "unchanged").otherwise("changed")
    out = j.select(*keys, status.alias("status"))
    return out.where("status <> 'deleted'") if full else out


def to_send(discovered: DataFrame, stored: DataFrame, keys: Sequence[str] = ("path",), hash_col: str = "content_hash") -> DataFrame:
    """Discovered rows without a stored row of the same keys and hash: an anti join, no outer join needed."""
    return discovered.join(stored.select(*keys, hash_col), [*keys, hash_col], "left_anti")


def to_delete(discovered: DataFrame, stored: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    return stored.join(discovered.select(*keys), list(keys), "left_anti")


def indexable(files: DataFrame, text_col: str = "content") -> DataFrame:
    """Files with content that is not blank and not over the size limit."""
    return files.where((F.octet_length(text_col) <= MAX_CONTENT) & (F.trim(text_col, F.lit(" \t\n\r")) != ""))


def latest_payloads(files: DataFrame) -> DataFrame:
    """Of payloads sent again, the one received last per file_id (ties by content hash). The contents are not sorted: the
    latest receipt is found on the narrow columns and joined back."""
    last = files.groupBy("file_id").agg(F.max(F.struct("received_at", "content_hash")).alias("_l"))
    j = files.join(last.withColumnRenamed("file_id", "_f"), (F.col("file_id") == F.col("_f")) & (F.col("received_at") == F.col("_l.received_at")) & F.col("content_hash").eqNullSafe(F.col("_l.content_hash")))
    return j.drop("_f", "_l").dropDuplicates(["file_id"])


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of the same keys replaced; of several new rows with one key any one stays."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.dropDuplicates(list(keys)), allowMissingColumns=True)


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys), list(keys), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {n: delete_keys(t, gone, [key]) for n, t in tables.items()}


def commit_version(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version of a table and switch to it: the pointer is renamed into place in one step on the folder's own
    file system, so that readers see either the old or the new version, and a run that fails changes nothing. Versions
    that are no longer current stay until ``drop_versions``."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{root}/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = file_system(spark, root)
    tmp, current = hadoop.Path(f"{root}/.current-{version}"), hadoop.Path(f"{root}/CURRENT")
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    names = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    over = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    names.rename(fs.makeQualified(tmp), fs.makeQualified(current), over)
    return version


def current_version(spark: SparkSession, root: str) -> str:
    """The version that a table's pointer names."""
    fs = file_system(spark, root)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT"))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_version(spark, root)}")


def drop_versions(spark: SparkSession, root: str) -> int:
    """Delete the versions of a table that are not current; the number deleted."""
    fs, keep, n = file_system(spark, root), current_version(spark, root), 0
    for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root)):
        if x.isDirectory() and x.getPath().getName() != keep:
            n += bool(fs.delete(x.getPath(), True))
    return n


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with the rows added as they are; a column that only one side has is null on the other."""
    return table.unionByName(rows, allowMissingColumns=True)


def project_stats(files: DataFrame, chunks: DataFrame, symbols: DataFrame, project_col: str = "project_path") -> DataFrame:
    """(project, total_files, total_chunks, total_symbols, stats json); a project of any of the tables counts."""
    f = files.groupBy(project_col).agg(F.count_distinct("file_id").alias("total_files"))
    c = chunks.groupBy(project_col).agg(F.count_distinct("chunk_id").alias("total_chunks"))
    s = symbols.groupBy(project_col).agg(F.count("*").alias("total_symbols"))
    j = f.join(c, project_col, "full_outer").join(s, project_col, "full_outer").fillna(0, ["total_files", "total_chunks", "total_symbols"])
    return j.withColumn("stats", F.to_json(F.struct("total_files", "total_chunks", "total_symbols")))


def directory_histogram(files: DataFrame, path_col: str = "path", n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The n directories with most files (per key); ties by path."""
    g = files.withColumn("dir", text.directory_bucket(F.col(path_col))).where("dir is not null").groupBy(*keys, "dir").agg(F.count("*").alias("file_count"))
    if not keys:
        return g.orderBy(F.desc("file_count"), "dir").limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc("file_count"), F.asc("dir"))
    return g.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def languages_of(files: DataFrame, path_col: str = "path", key: str = "project_path") -> DataFrame:
    """(key, languages json): the sorted languages that the paths of each key tell."""
    lang = text.detect_language(F.col(path_col))
    return files.select(key, lang.alias("l")).where("l is not null").distinct().groupBy(key).agg(F.to_json(F.array_sort(F.collect_list("l"))).alias("languages"))


def batches_of(rows: DataFrame, order: Sequence[str], size: int, key: str) -> DataFrame:
    """Rows with the number of their batch of ``size`` within their key, in order; a size of 0 or less counts as 5, one
    over 50 as 50. Positions are counted in two levels, so that a large key is many tasks."""
    n = min(size, MAX_BATCH) if size > 0 else DEFAULT_BATCH
    return prefix.numbered(rows, [key], order, "_at").withColumn("batch_no", F.floor(F.col("_at") / n)).drop("_at")


def run_totals(batches: DataFrame, key: str) -> DataFrame:
    return batches.groupBy(key).agg(F.sum("files").alias("files_processed"), F.sum("chunks").alias("chunks_created"))


def backfill_hash(projects: DataFrame) -> DataFrame:
    """path_hash filled where it is null or empty."""
    from ..functions.ident import path_hash

    return projects.withColumn("path_hash", F.coalesce(F.nullif(F.col("path_hash"), F.lit("")), path_hash(F.col("host_path"))))


def latest_run(runs: DataFrame, key: str, at: str, fields: Sequence[str]) -> DataFrame:
    """The latest row of each key, as one aggregate."""
    return runs.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, *fields)).alias("r")).select(key, "r.*")
