"""Registered queries of runs, access and streams, over tables that stand for the index's own, and their SQL.

Customers stand for users (admins are those of one market segment), orders for sessions and keys, events for attempts,
progress lines and runs; projects, files, chunks and symbols are themselves. Recursive SQL walks each key's rows in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import access, chunking, ingest, paths, runs, search, symbols
from ..session import table
from ..sources import embedders
from ..streaming import folds, watch
from .oracle import ORACLE
from .queries import files, query

NOW = "1998-03-01 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("viewer").alias("role"), F.when(F.col("c_acctbal") < 0, _now()).alias("disabled_at"))


def _sessions(spark, d):
    made = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), made.alias("created_at"), (made + F.expr("interval 14 days")).alias("expires_at"), made.alias("last_seen_at"))


def _keys(spark, d):
    made = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key_hash"), F.col("o_custkey").alias("owner_id"), made.alias("created_at"), F.when(F.col("o_orderstatus") == "F", made).alias("revoked_at"))


_USERS = "u AS (SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'viewer' END AS role, c_acctbal < 0 AS disabled FROM customer)"
_SESSIONS = f"s AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderdate + INTERVAL 14 DAY AS expires_at, o_orderdate + INTERVAL 14 DAY > TIMESTAMP '{NOW}' AS live FROM orders)"


@query
def key_states(spark, d):
    return access.key_status(_keys(spark, d), _users(spark, d)).groupBy("status").agg(F.count("*").alias("keys"))


ORACLE["key_states"] = f"WITH {_USERS} SELECT CASE WHEN o_orderstatus = 'F' OR user_id IS NULL THEN 'invalid' WHEN disabled THEN 'disabled' ELSE 'valid' END AS status, count(*) AS keys FROM orders LEFT JOIN u ON user_id = o_custkey GROUP BY 1"


@query
def session_states(spark, d):
    return access.session_status(_sessions(spark, d), _users(spark, d), _now()).groupBy("status").agg(F.count("*").alias("sessions"))


ORACLE["session_states"] = f"WITH {_USERS}, {_SESSIONS} SELECT CASE WHEN u.user_id IS NULL THEN 'unknown' WHEN NOT live THEN 'expired' WHEN disabled THEN 'disabled' ELSE 'valid' END AS status, count(*) AS sessions FROM s LEFT JOIN u USING (user_id) GROUP BY 1"


@query
def session_cleanup(spark, d):
    return access.expired(_sessions(spark, d), _now()).groupBy("user_id").agg(F.count("*").alias("deleted"))


ORACLE["session_cleanup"] = f"WITH {_SESSIONS} SELECT user_id, count(*) AS deleted FROM s WHERE NOT live GROUP BY 1"


@query
def live_sessions_of_users(spark, d):
    return access.unexpired(_sessions(spark, d), _now()).groupBy("user_id").agg(F.count("*").alias("live"))


ORACLE["live_sessions_of_users"] = f"WITH {_SESSIONS} SELECT user_id, count(*) AS live FROM s WHERE live GROUP BY 1"


@query
def session_touch(spark, d):
    s = _sessions(spark, d)
    uses = s.select("session_id", (F.col("created_at") + F.make_dt_interval((F.col("session_id") % 20).cast("int"))).alias("at"))
    return access.touched(s, uses).select("session_id", F.unix_micros("last_seen_at").alias("seen_us"), F.unix_micros("expires_at").alias("expires_us"))


ORACLE["session_touch"] = """
WITH s AS (SELECT o_orderkey AS session_id, o_orderdate AS c, (o_orderkey % 20)::INTEGER AS k FROM orders)
SELECT session_id, epoch_us(c + to_days(CASE WHEN k < 14 THEN k ELSE 0 END)) AS seen_us, epoch_us(c + to_days(14 + CASE WHEN k < 14 THEN k ELSE 0 END)) AS expires_us FROM s
"""


@query
def other_sessions(spark, d):
    return access.others(_sessions(spark, d), 7, 1).select("session_id")


ORACLE["other_sessions"] = "SELECT o_orderkey AS session_id FROM orders WHERE o_custkey = 7 AND o_orderkey <> 1"


@query
def visible_keys(spark, d):
    v = access.visible_keys(_keys(spark, d), _users(spark, d).withColumn("want_all", F.col("user_id") % 2 == 0))
    return v.groupBy("viewer_id").agg(F.count("key_id").alias("own_keys"), (F.count("*") > F.count("key_id")).alias("sees_all"))


ORACLE["visible_keys"] = f"""WITH {_USERS}
SELECT user_id AS viewer_id, count(*) AS own_keys, false AS sees_all FROM u JOIN orders ON o_custkey = user_id WHERE NOT (role = 'admin' AND user_id % 2 = 0) GROUP BY 1
UNION ALL SELECT user_id, 0, true FROM u WHERE role = 'admin' AND user_id % 2 = 0"""


@query
def removable_users(spark, d):
    u = access.removable(_users(spark, d))
    return u.groupBy("role", access.may_change(F.col("role")).alias("may_change"), "removable").agg(F.count("*").alias("users"))


ORACLE["removable_users"] = f"WITH {_USERS} SELECT role, role = 'admin' AS may_change, NOT (role = 'admin' AND NOT disabled AND (SELECT count(*) FROM u WHERE role = 'admin' AND NOT disabled) <= 1) AS removable, count(*) AS users FROM u GROUP BY ALL"


@query
def user_counts(spark, d):
    u = access.user_counts(_users(spark, d).select("user_id"), _sessions(spark, d), _keys(spark, d), _now())
    return u.select("user_id", F.unix_micros("last_login").alias("last_login_us"), "live_sessions", "active_keys")


ORACLE["user_counts"] = f"""WITH {_USERS}, {_SESSIONS}
SELECT user_id, (SELECT max(epoch_us(created_at)) FROM s WHERE s.user_id = u.user_id) AS last_login_us, (SELECT count(*) FROM s WHERE s.user_id = u.user_id AND live) AS live_sessions,
  (SELECT count(*) FROM orders WHERE o_custkey = user_id AND o_orderstatus <> 'F') AS active_keys FROM u"""


@query
def newest_projects(spark, d):
    return symbols.newest_first(table(spark, d, "projects"), "updated_at", "host_path", 20).select("host_path", F.unix_micros("updated_at").alias("updated_us"))


ORACLE["newest_projects"] = "SELECT host_path, epoch_us(updated_at) AS updated_us FROM projects ORDER BY updated_at DESC, host_path LIMIT 20"


# -- runs ---------------------------------------------------------------------------------------------------------------

ATLAS = "/srv/code/atlas"


def _index(spark, d) -> runs.Index:
    p = F.col("file_path").alias("path")
    s = table(spark, d, "symbols")
    return {
        "hashes": files(spark, d).select("project_path", "path", "content_hash"), "chunks": table(spark, d, "chunks").select("project_path", p, "chunk_id").distinct(),
        "symbols": s.select("project_path", p, "symbol_id"), "refs": s.where("parent_name is not null").select("project_path", p, F.col("parent_name").alias("name"), "line"),
    }


def _runs(spark, d):
    e = F.col("event_id")
    status = F.when(F.col("event_type").isin("view", "click"), "running").otherwise("completed")
    return table(spark, d, "events").select(e.cast("string").alias("run_id"), F.concat(F.lit("p"), F.col("user_id")).alias("project_path"), status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"), (e % 50).cast("int").alias("files_processed"), (e % 70).cast("int").alias("chunks_created"), "event_type")


def _rows(index: runs.Index):
    out = None
    for n, t in index.items():
        c = t.groupBy().agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


@query
def index_begin(spark, d):
    """Rows of each table after a full run of one project has begun, and the hashes that an incremental one is given."""
    index, all_runs = _index(spark, d), _runs(spark, d).select("run_id", "project_path", "status", "started_at")
    wiped, more, _ = runs.begin(index, all_runs, ATLAS, "new", _now(), full=True)
    stored = runs.begin(index, all_runs, ATLAS, "new", _now())[2]
    count = lambda t, n: t.groupBy().agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
    return _rows(wiped).unionByName(count(more, "runs")).unionByName(count(stored, "stored"))


_INDEX = """h AS (SELECT DISTINCT project_path, path, content_hash FROM (SELECT DISTINCT file_id, project_path, path, content_hash FROM file_payloads)), c AS (SELECT DISTINCT project_path, file_path AS path, chunk_id FROM chunks),
y AS (SELECT project_path, file_path AS path, symbol_id FROM symbols), r AS (SELECT project_path, file_path AS path, parent_name AS name, line FROM symbols WHERE parent_name IS NOT NULL)"""
ORACLE["index_begin"] = f"""WITH {_INDEX} SELECT 'hashes' AS name, count(*) AS rows FROM h WHERE project_path <> '{ATLAS}' UNION ALL SELECT 'chunks', count(*) FROM c WHERE project_path <> '{ATLAS}' UNION ALL SELECT 'symbols', count(*) FROM y WHERE project_path <> '{ATLAS}'
UNION ALL SELECT 'refs', count(*) FROM r WHERE project_path <> '{ATLAS}' UNION ALL SELECT 'runs', count(*) + 1 FROM events UNION ALL SELECT 'stored', count(*) FROM h WHERE project_path = '{ATLAS}'"""


@query
def index_process(spark, d):
    """Rows of each table after a batch has replaced those of its files."""
    index = _index(spark, d)
    batch = files(spark, d).where("file_id % 3 = 0").select("project_path", "path", F.sha2("path", 256).alias("content_hash"), "file_id")
    two = batch.select("project_path", "path", F.explode(F.array(F.col("file_id") * -2, F.col("file_id") * -2 - 1)).alias("chunk_id"))
    out = runs.process(index, batch, two, batch.select("project_path", "path", F.col("file_id").cast("string").alias("symbol_id")), batch.select("project_path", "path", F.lit("x").alias("name"), F.lit(1).alias("line")).limit(0))
    fresh = out["hashes"].where(F.col("content_hash") == F.sha2("path", 256)).groupBy().agg(F.count("*").alias("rows")).select(F.lit("replaced").alias("name"), "rows")
    return _rows(out).unionByName(fresh)


ORACLE["index_process"] = f"""WITH {_INDEX}, b AS (SELECT DISTINCT project_path, path FROM file_payloads WHERE file_id % 3 = 0), n AS (SELECT count(*) AS n FROM b)
SELECT 'hashes' AS name, count(*) AS rows FROM h UNION ALL SELECT 'replaced', n FROM n UNION ALL SELECT 'chunks', count(*) + any_value(2 * n) FROM c, n WHERE path NOT IN (SELECT path FROM b)
UNION ALL SELECT 'symbols', count(*) + any_value(n) FROM y, n WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT 'refs', count(*) FROM r WHERE path NOT IN (SELECT path FROM b)"""


@query
def index_finish(spark, d):
    """Statistics of each project after a run has deleted the rows of files that are gone."""
    gone = files(spark, d).where("file_id % 5 = 0").select("project_path", "path")
    return runs.finish(_index(spark, d), gone)[1]


@query
def run_cancel(spark, d):
    r = _runs(spark, d)
    return runs.ended(r, r.where("cast(run_id as bigint) % 3 = 0"), "cancelled").groupBy("status").agg(F.count("*").alias("runs"))


ORACLE["run_cancel"] = "SELECT CASE WHEN event_type NOT IN ('view', 'click') THEN 'completed' WHEN event_id % 3 = 0 THEN 'cancelled' ELSE 'running' END AS status, count(*) AS runs FROM events GROUP BY 1"


@query
def index_status(spark, d):
    r = _runs(spark, d)
    live = r.where("event_type = 'signup' and cast(run_id as bigint) % 16 = 0").withColumn("status", F.lit("active"))
    projects = r.select("project_path").distinct().unionByName(spark.createDataFrame([("idle",)], "project_path string"))
    return runs.index_status(projects, live, r.where("event_type <> 'signup'"), F.lit("2024-02-01 00:00:00").cast("timestamp"))


ORACLE["index_status"] = """
WITH e AS (SELECT *, 'p' || user_id AS project_path, (event_id % 50)::INTEGER AS f, (event_id % 70)::INTEGER AS c FROM events),
l AS (SELECT * FROM e WHERE event_type = 'signup' AND event_id % 16 = 0 QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY ts DESC, event_id::VARCHAR DESC) = 1),
r AS (SELECT * FROM e WHERE event_type <> 'signup' QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY ts DESC, event_id::VARCHAR DESC) = 1), p AS (SELECT DISTINCT project_path FROM e UNION ALL SELECT 'idle')
SELECT p.project_path, CASE WHEN l.event_id IS NOT NULL THEN 'indexing' WHEN r.event_type IN ('view', 'click') THEN 'running' WHEN r.event_id IS NOT NULL THEN 'completed' ELSE 'idle' END AS status,
  coalesce(l.event_id, r.event_id)::VARCHAR AS run_id, coalesce(l.f, r.f) AS files_processed, coalesce(l.c, r.c) AS chunks_created, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(l.ts))::DOUBLE / 100000.0::DOUBLE + 0.5::DOUBLE) / 10 AS elapsed_seconds
FROM p LEFT JOIN l USING (project_path) LEFT JOIN r USING (project_path)
"""


@query
def server_status(spark, d):
    return runs.server_status(table(spark, d, "projects"), _runs(spark, d), True)


ORACLE["server_status"] = "SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS running, true AS model_ready"


@query
def run_sessions_left(spark, d):
    s = _runs(spark, d).select(F.when(F.col("event_type") == "view", "active").otherwise("done").alias("status"), "started_at", (F.col("started_at") + F.expr("interval 30 minutes")).alias("ended_at"))
    return runs.live_sessions(s, F.lit("2024-01-20 12:00:00").cast("timestamp"), 5 * 86400, 3 * 86400).groupBy("status").agg(F.count("*").alias("sessions"))


ORACLE["run_sessions_left"] = """
SELECT CASE WHEN event_type = 'view' THEN 'active' ELSE 'done' END AS status, count(*) AS sessions FROM events
WHERE CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-01-20 12:00:00' - ts < INTERVAL 120 HOUR ELSE TIMESTAMP '2024-01-20 12:00:00' - (ts + INTERVAL 30 MINUTE) < INTERVAL 72 HOUR END GROUP BY 1
"""


@query
def project_details(spark, d):
    p = runs.project_details(table(spark, d, "projects"), files(spark, d), table(spark, d, "symbols"))
    dirs = F.array_join(F.transform("top_directories", lambda x: F.concat(x["path"], F.lit(":"), x["files"])), ",")
    some = F.array_join(F.transform("recent_symbols", lambda x: F.concat(x["file_path"], F.lit(":"), x["line"], F.lit(":"), x["name"])), ",")
    return p.select("project_path", "status", "languages", "total_files", "total_symbols", dirs.alias("directories"), some.alias("symbols"))


@query
def project_create(spark, d):
    dirs = files(spark, d).select(F.regexp_extract("path", r"^((?:/[^/]+){4})/", 1).alias("path")).where("path <> ''").distinct()
    beside = table(spark, d, "projects").select(F.explode(F.array(F.col("host_path"), F.concat("host_path", F.lit("-next")))).alias("path"))
    return paths.creatable(table(spark, d, "projects").select(F.col("host_path").alias("path")), dirs.unionByName(beside).distinct())


ORACLE["project_create"] = """
WITH c AS (SELECT DISTINCT regexp_extract(path, '^((?:/[^/]+){4})/', 1) AS path FROM file_payloads UNION SELECT host_path FROM projects UNION SELECT host_path || '-next' FROM projects)
SELECT path, CASE WHEN path IN (SELECT host_path FROM projects) THEN 'exists' WHEN EXISTS (SELECT 1 FROM projects WHERE starts_with(path, host_path || '/') OR starts_with(host_path, path || '/')) THEN 'overlaps' ELSE 'new' END AS status FROM c WHERE path <> ''
"""


@query
def project_changes(spark, d):
    """Projects after some have been patched and others deleted."""
    p = table(spark, d, "projects").select("host_path", "settings", "status")
    patched = p.where("path_hash < '8'").select("host_path", F.lit("{}").alias("settings"), "status") if "path_hash" in p.columns else p.where(F.sha1("host_path") < "8").select("host_path", F.lit("{}").alias("settings"), "status")
    return ingest.delete_keys(ingest.upsert(p, patched, ["host_path"]), p.where("status = 'error'"), ["host_path"]).select("host_path", "settings")


ORACLE["project_changes"] = "SELECT host_path, CASE WHEN sha1(host_path) < '8' THEN '{}' ELSE settings END AS settings FROM projects WHERE status <> 'error' OR status IS NULL"


@query
def upsert_hashes(spark, d):
    old = files(spark, d).where("file_id % 5 <> 0").select("path", F.lit("old").alias("content_hash"))
    return ingest.upsert(old, files(spark, d).where("file_id % 3 <> 0").select("path", "content_hash"), ["path"])


ORACLE["upsert_hashes"] = "SELECT path, any_value(CASE WHEN file_id % 3 <> 0 THEN content_hash ELSE 'old' END) AS content_hash FROM file_payloads WHERE file_id % 5 <> 0 OR file_id % 3 <> 0 GROUP BY path"


@query
def append_references(spark, d):
    r = _index(spark, d)["refs"]
    return ingest.append(r, r.where("line < 20").drop("line")).groupBy("project_path").agg(F.count("*").alias("rows"), F.count("line").alias("with_line"))


ORACLE["append_references"] = "SELECT project_path, count(*) + count_if(line < 20) AS rows, count(*) AS with_line FROM symbols WHERE parent_name IS NOT NULL GROUP BY 1"


@query
def run_totals(spark, d):
    return ingest.run_totals(_runs(spark, d).select("project_path", F.col("files_processed").alias("files"), F.col("chunks_created").alias("chunks")), "project_path")


ORACLE["run_totals"] = "SELECT 'p' || user_id AS project_path, sum(event_id % 50)::BIGINT AS files_processed, sum(event_id % 70)::BIGINT AS chunks_created FROM events GROUP BY 1"


@query
def collections(spark, d):
    c = table(spark, d, "chunks").select("project_path", "chunk_id").distinct()
    return embedders.collection_counts(embedders.drop_collection(c, ATLAS))


ORACLE["collections"] = f"SELECT 'project_' || md5(project_path) AS collection, count(DISTINCT chunk_id) AS vectors FROM chunks WHERE project_path <> '{ATLAS}' GROUP BY 1"


@query
def wire_payloads(spark, d):
    """Files per request: some requests are too large, some are no JSON."""
    one = F.struct("path", "content_hash", "language")
    per = files(spark, d).groupBy("project_path", F.floor(F.col("file_id") / 400).alias("part")).agg(F.collect_list(one).alias("files"))
    body = F.when(F.size("files") == 1, "{").otherwise(F.to_json(F.struct("files")))
    got = embedders.wire_payloads(per.select(F.concat_ws("/", "project_path", "part").alias("request_id"), body.alias("value")))
    return got.select("request_id", F.coalesce(F.size("files"), F.lit(0)).alias("files"), "error")


ORACLE["wire_payloads"] = """
WITH r AS (SELECT project_path || '/' || (file_id // 400) AS request_id, count(DISTINCT file_id) AS n FROM file_payloads GROUP BY 1)
SELECT request_id, CASE WHEN n = 1 OR n > 50 THEN 0 ELSE n END::INTEGER AS files, CASE WHEN n = 1 THEN 'invalid' WHEN n > 50 THEN 'too many files' END AS error FROM r
"""


@query
def project_symbols(spark, d):
    return symbols.project_symbols(table(spark, d, "symbols"), ATLAS).select("symbol_id", "kind", "name", "file_path", "line")


ORACLE["project_symbols"] = f"SELECT symbol_id, kind, name, file_path, line FROM symbols WHERE project_path = '{ATLAS}' ORDER BY kind, name, file_path, line"


@query
def recent_symbols(spark, d):
    return symbols.first_symbols(table(spark, d, "symbols")).select("project_path", "symbol_id", "name", "kind")


ORACLE["recent_symbols"] = "SELECT project_path, symbol_id, name, kind FROM symbols QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY file_path, line, name, symbol_id) <= 20"


@query
def chunk_symbols(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "chunk_type", "symbol_name", "content").distinct()
    s = chunking.symbols_of_chunks(c)
    return s.select("chunk_id", "chunk_type", "symbol_name", F.md5(text.signature_of(F.col("content"))).alias("signature_md5"))


ORACLE["chunk_symbols"] = "SELECT DISTINCT chunk_id, chunk_type, symbol_name, md5(trim(string_split(content, chr(10))[1], ' ' || chr(9) || chr(13) || chr(10))) AS signature_md5 FROM chunks WHERE chunk_type IN ('function', 'class', 'method', 'type') AND symbol_name IS NOT NULL"


@query
def references_elsewhere(spark, d):
    """Uses of names other than at their own definitions, per name."""
    f = table(spark, d, "file_payloads").select("path", "language", "content")
    r = symbols.extract_references(f).select("name", "file_path", "line", "col").distinct()
    return symbols.without_definitions(r, table(spark, d, "symbols")).groupBy("name").agg(F.count("*").alias("uses"))


@query
def text_search(spark, d):
    """Files whose chunks begin most like a text, by vectors of their first bytes."""
    c = table(spark, d, "chunks").where("content is not null").select("chunk_id", "file_path", "start_line", "end_line", "language", "symbol_name", "chunk_type", "content").distinct()
    docs = embedders.embed_column(c, "content", "embedding", lambda: embedders.byte_embedder(16)).withColumnRenamed("chunk_id", "doc_id").drop("content")
    g = search.text_search(docs, "def load_token(self, x):", lambda: embedders.byte_embedder(16), limit=10, min_score=0.9)
    return g.select("file_path", "best_score")


_BYTES = "list_transform(range(0, 16), lambda i: coalesce((ascii(h[2 * i + 1]) - CASE WHEN ascii(h[2 * i + 1]) > 60 THEN 55 ELSE 48 END) * 16 + ascii(h[2 * i + 2]) - CASE WHEN ascii(h[2 * i + 2]) > 60 THEN 55 ELSE 48 END, 0) / 255.0::DOUBLE)"
_FIRST = "CASE WHEN octet_length(encode({0})) >= 16 THEN hex(encode({0})) ELSE rpad(hex(encode({0})), 32, '0') END"
ORACLE["text_search"] = f"""
WITH c AS (SELECT DISTINCT chunk_id, file_path, {_FIRST.format('content')} AS h FROM chunks WHERE content IS NOT NULL), q AS (SELECT {_BYTES} AS e FROM (SELECT {_FIRST.format("'def load_token(self, x):'")} AS h)),
s AS (SELECT chunk_id, file_path, round(list_cosine_similarity({_BYTES}::FLOAT[]::DOUBLE[], q.e), 4) AS score FROM c, q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s WHERE NOT isnan(score) QUALIFY rank <= 160), f AS (SELECT * FROM r WHERE score >= 0.9),
w AS (SELECT min(n) AS n FROM (SELECT n, (SELECT count(DISTINCT file_path) FROM f WHERE rank <= n) AS files, (SELECT count(*) FROM r WHERE rank <= n) AS raw FROM (VALUES (20), (40), (80), (160)) t(n)) WHERE files >= 10 OR raw < n OR n = 160)
SELECT file_path, max(score) AS best_score FROM f, w WHERE rank <= w.n GROUP BY file_path ORDER BY best_score DESC, file_path LIMIT 10
"""


@query
def search_total(spark, d):
    """The number of file groups that each search has."""
    h = table(spark, d, "search_hits").where("file_path is not null and score is not null")
    return search.passing(h, 0.4).groupBy("search_id").agg(F.count_distinct("file_path").alias("total"))


ORACLE["search_total"] = "SELECT search_id, count(DISTINCT file_path) AS total FROM search_hits WHERE file_path IS NOT NULL AND score >= 0.4 GROUP BY 1"


@query
def text_functions(spark, d):
    k = F.col("c_custkey")
    of = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    email = F.concat(F.lit("  "), F.upper("c_name"), F.lit("@X.org "))
    at = F.timestamp_micros(k * 86_400_000_000 + k * 1_001)
    meta = F.create_map(F.lit("start_line"), of("12", "x", "-3"))
    return table(spark, d, "customer").select(
        k.alias("id"), text.normalized_email(email).alias("email"), text.limiter_key(of("10.0.0.1", "::1"), email).alias("key"), text.key_prefix(F.sha2("c_name", 256)).alias("prefix"),
        text.status_label(of("indexed", "indexing", "created", "error", "odd")).alias("label"), text.directory_of_repository(F.concat(F.lit("own/"), "c_name")).alias("dir"), text.repository_of_directory(F.concat(F.lit("own__a__"), "c_name")).alias("repo"),
        scores.retry_after_seconds(of("0", "17", "500", "x", "", "-4"), 2.5).alias("retry"), text.rfc3339(at).alias("at"), F.unix_micros(text.parsed_time(of("2024-01-02 03:04:05", "bad"))).alias("parsed"),
        text.int_or_zero(meta["start_line"]).alias("line"), text.int_or_zero(F.try_element_at(meta, F.lit("none"))).alias("none"), scores.elapsed_seconds(at, at + F.expr("interval 90 seconds")).alias("took"), runs.shown_status(of("active", "cancelled")).alias("shown"),
        F.nullif(of("", "m"), F.lit("")).alias("model"), text.query_prefix(of("x/CodeRankEmbed-Q8", "bge-base-en", "none")).alias("instruction"), text.first_hop(of("1.1.1.1, 2.2.2.2", " "), F.lit("9.9.9.9:80")).alias("hop"), text.accepts(of("text/html, Application/x-ndjson;q=1", "*/*"), "application/x-ndjson").alias("streams"),
    )


def _of(*xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + f"][(c_custkey % {len(xs)} + 1)::INTEGER]"


ORACLE["text_functions"] = f"""
SELECT c_custkey AS id, lower(upper(c_name) || '@X.org') AS email, {_of('10.0.0.1', '::1')} || '|' || lower(c_name || '@x.org') AS key, sha256(c_name)[1:12] AS prefix, {_of('✓ Indexed', '⏳ Indexing', '○ Created (not indexed)', '✗ Error', 'odd')} AS label,
  'own__' || c_name AS dir, 'own/a__' || c_name AS repo, [2.5, 17, 120, 2.5, 2.5, 2.5][(c_custkey % 6 + 1)::INTEGER]::DOUBLE AS retry, strftime(make_timestamp(c_custkey * 86400000000 + c_custkey * 1001), '%Y-%m-%dT%H:%M:%S.%fZ') AS at,
  CASE WHEN c_custkey % 2 = 0 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05') END AS parsed, [12, 0, -3][(c_custkey % 3 + 1)::INTEGER]::INTEGER AS line, 0::INTEGER AS none, 90.0::DOUBLE AS took, {_of('indexing', 'cancelled')} AS shown, nullif({_of('', 'm')}, '') AS model,
  {_of('Represent this query for searching relevant code: ', 'Represent this sentence for searching relevant passages: ', '')} AS instruction, {_of('1.1.1.1', '9.9.9.9')} AS hop, c_custkey % 2 = 0 AS streams FROM customer
"""


# -- streams ------------------------------------------------------------------------------------------------------------


def _lines(spark, d):
    return table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type", "event_id")


_T = "t AS (SELECT user_id, epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE AS t, event_type, event_id FROM events)"


@query
def login_limits(spark, d):
    a = _lines(spark, d).select(F.col("event_id").alias("attempt_id"), (F.col("user_id") % 10).alias("address"), F.concat(F.lit(" U"), F.col("user_id")).alias("email"), "t", (F.col("event_type") == "purchase").alias("success"))
    return folds.login_limits(a, (2, 4 * 86400.0), (12, 86400.0))


ORACLE["login_limits"] = f"""
WITH RECURSIVE {_T}, o AS (SELECT user_id % 10 AS a, user_id AS u, event_id, t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY t, event_id) AS i FROM t),
f AS (
  SELECT a, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::DOUBLE AS t, false AS allowed, 0::DOUBLE AS retry, []::DOUBLE[] AS la, []::STRUCT(u BIGINT, t DOUBLE)[] AS lp FROM (SELECT DISTINCT a FROM o)
  UNION ALL
  SELECT a, i, event_id, t, ra IS NULL AND rp IS NULL, coalesce(ra, rp, 0)::DOUBLE, CASE WHEN ra IS NULL AND rp IS NULL THEN list_append(la, t) ELSE la END,
    CASE WHEN ra IS NULL AND rp IS NULL THEN CASE WHEN ok THEN list_filter(lp, lambda x: x.u <> u) ELSE list_append(lp, {{'u': u, 't': t}}) END ELSE lp END
  FROM (SELECT *, CASE WHEN len(la) >= 12 THEN greatest(86400.0::DOUBLE - (t - la[1]), 1.0::DOUBLE) END AS ra, CASE WHEN len(mine) >= 2 THEN greatest(345600.0::DOUBLE - (t - mine[1].t), 1.0::DOUBLE) END AS rp
        FROM (SELECT *, list_filter(lp, lambda x: x.u = u) AS mine
              FROM (SELECT o.a, o.i, o.u, o.event_id, o.t, o.ok, list_filter(f.la, lambda x: x >= o.t - 86400) AS la, list_filter(f.lp, lambda x: x.t >= o.t - 345600) AS lp FROM f JOIN o ON o.a = f.a AND o.i = f.i + 1)))
)
SELECT a AS address, event_id AS attempt_id, t, allowed, retry AS retry_after FROM f WHERE i > 0
"""


@query
def restart_budget(spark, d):
    e = _lines(spark, d).where("event_type = 'error'").select("user_id", F.col("event_id").alias("failure_id"), "t")
    return folds.restart_budget(e, "user_id", 3, 3 * 86400.0)


ORACLE["restart_budget"] = f"""
WITH RECURSIVE {_T}, o AS (SELECT user_id AS k, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM t WHERE event_type = 'error'),
f AS (
  SELECT k, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::DOUBLE AS t, []::DOUBLE[] AS l, false AS was, false AS dead FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT k, i, event_id, t, l, was, was OR len(l) > 3 FROM (SELECT o.k, o.i, o.event_id, o.t, list_append(list_filter(f.l, lambda x: x > o.t - 259200), o.t) AS l, f.dead AS was FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
)
SELECT k AS user_id, event_id AS failure_id, t, CASE WHEN NOT was THEN len(l)::INTEGER END AS attempt, CASE WHEN NOT dead THEN pow(2, len(l) - 1)::DOUBLE END AS backoff, dead FROM f WHERE i > 0
"""


@query
def debounce_routed(spark, d):
    action = F.when(F.col("event_type") == "purchase", "full").when(F.col("event_type") == "signup", "immediate").when(F.col("event_type") == "error", "drop").otherwise("track")
    return folds.debounce_routed(_lines(spark, d).select("user_id", "t", F.col("event_type").alias("path"), action.alias("action")), "user_id", 5 * 3600)


ORACLE["debounce_routed"] = f"""
WITH {_T}, o AS (
  SELECT user_id, t, event_type, event_type IN ('purchase', 'signup') AS now, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER w AS g, lag(t) OVER w AS lt, lag(event_type) OVER w IN ('purchase', 'signup') AS ln
  FROM t WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)
), s AS (SELECT *, sum(CASE WHEN lt IS NULL OR ln OR now OR t - lt >= 18000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM o),
p AS (SELECT user_id, k, max(t) AS l, count(*)::INTEGER AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths, bool_or(now) AS now, min(event_type) AS e FROM s GROUP BY 1, 2),
q AS (SELECT *, lead(now) OVER (PARTITION BY user_id ORDER BY k) AS cut, lead(l) OVER (PARTITION BY user_id ORDER BY k) AS nl FROM p)
SELECT user_id, CASE WHEN now THEN l ELSE l + 18000 END AS at, CASE WHEN NOT now THEN 'incremental' WHEN e = 'purchase' THEN 'full' ELSE 'immediate' END AS kind, n AS events, paths FROM q WHERE now OR cut IS NOT TRUE OR nl - l >= 18000
"""


@query
def heartbeats(spark, d):
    return folds.heartbeats(_lines(spark, d), "user_id", 6 * 3600.0)


ORACLE["heartbeats"] = f"WITH {_T}, o AS (SELECT DISTINCT user_id, t FROM t), g AS (SELECT user_id, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS f, t FROM o), n AS (SELECT *, ceil((t - f) / 21600.0::DOUBLE)::BIGINT - 1 AS n FROM g WHERE f IS NOT NULL) SELECT user_id, f + i * 21600.0::DOUBLE AS t FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)"


@query
def idle_aborts(spark, d):
    return folds.idle_aborts(_lines(spark, d), "user_id", 36 * 3600.0)


ORACLE["idle_aborts"] = f"WITH {_T}, g AS (SELECT user_id, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS f, t FROM (SELECT DISTINCT user_id, t FROM t)) SELECT user_id, min(f) + 129600.0::DOUBLE AS t FROM g WHERE t - f > 129600 GROUP BY 1"


@query
def sync_ticks(spark, d):
    return folds.sync_ticks(_lines(spark, d).groupBy("user_id").agg(F.min("t").alias("begin"), F.max("t").alias("end")), "user_id", 86400.0)


ORACLE["sync_ticks"] = f"WITH {_T}, s AS (SELECT user_id, min(t) AS b, max(t) AS e FROM t GROUP BY 1) SELECT user_id, b + i * 86400.0::DOUBLE AS t FROM (SELECT *, unnest(range(0, floor((e - b) / 86400.0::DOUBLE)::BIGINT + 1)) AS i FROM s)"


@query
def run_outcomes(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 7).cast("string").alias("run_id"), F.when(F.col("event_type") == "purchase", "batch_done").when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "error").otherwise("file_done").alias("event"), F.lit("x").alias("path"))
    return watch.outcome_of(watch.parse_progress(watch.to_progress(e)))


ORACLE["run_outcomes"] = """
WITH e AS (SELECT (event_id // 7)::VARCHAR AS run_id, event_type = 'purchase' AS d, event_type = 'error' AND event_id % 2 = 0 AS x FROM events)
SELECT run_id, count(*) AS lines, CASE WHEN count_if(d) + count_if(x) <> 1 THEN 'broken' WHEN count_if(x) = 1 THEN 'failed' ELSE 'done' END AS outcome FROM e GROUP BY 1
"""
