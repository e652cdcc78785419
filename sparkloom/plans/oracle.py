"""SQL for DuckDB that each registered query is compared with."""

from __future__ import annotations

# Fixed values, written out here so that the SQL does not depend on the library it checks: languages by name and by
# extension (of the index, of the client), names that are no references, directories and extensions that a watcher drops.
_OF_NAME = "CMakeLists.txt=cmake Makefile=make GNUmakefile=make Dockerfile=dockerfile"
_OF_EXTENSION = (
    ".py=python .go=go .rs=rust .java=java .c=c .h=c .cpp=cpp .cc=cpp .cxx=cpp .hpp=cpp .cs=c_sharp .swift=swift .kt=kotlin .kts=kotlin .scala=scala .zig=zig .jl=julia "
    ".f90=fortran .f95=fortran .f03=fortran .f=fortran .m=objc .mm=objc .ts=typescript .tsx=tsx .js=javascript .jsx=javascript .rb=ruby .php=php .lua=lua .sh=bash .bash=bash "
    ".zsh=bash .r=r .dart=dart .ex=elixir .exs=elixir .erl=erlang .hs=haskell .ml=ocaml .lisp=commonlisp .cl=commonlisp .svelte=svelte .html=html .css=css .scss=scss .sql=sql "
    ".yaml=yaml .yml=yaml .json=json .toml=toml .xml=xml .md=markdown .graphql=graphql .gql=graphql .re=regex .tf=hcl .hcl=hcl .cmake=cmake "
)
_OF_EXTENSION_CLIENT = (
    ".py=python .go=go .rs=rust .java=java .c=c .h=c .cpp=cpp .cc=cpp .cxx=cpp .hpp=cpp .cs=c_sharp .swift=swift .kt=kotlin .scala=scala .ts=typescript .js=javascript "
    ".jsx=javascript .rb=ruby .php=php .lua=lua .sh=bash .bash=bash .zsh=bash .r=r .dart=dart .ex=elixir .exs=elixir .erl=erlang .hs=haskell .ml=ocaml .svelte=svelte "
    ".html=html .css=css .scss=scss .sql=sql .yaml=yaml .yml=yaml .json=json .toml=toml .xml=xml .md=markdown .tf=hcl .tsx=typescript .rst=rst .proto=protobuf .vue=vue "
)
_NO_REFERENCES = (
    "self cls None True False print len range type list dict set tuple int str float bool bytes object Exception isinstance hasattr getattr setattr undefined null true false "
    "console window document Array Object String Number Boolean Promise Map Set nil fmt err ctx Ok Err Some this super void "
)
_DIRS = "node_modules .git .venv __pycache__ dist build .next .cache .DS_Store .idea .vscode vendor target .svn .hg coverage .nyc_output .tox .eggs .gradle .mvn"
_EXTENSIONS = ".pyc .pyo .class .o .obj .exe .dll .so .dylib .a .lib .jpg .jpeg .png .gif .ico .svg .mp3 .mp4 .avi .mov .wav .zip .tar .gz .rar .7z .lock .sum .swp .swx .swo .tmp .bak"

ORACLE: dict[str, str] = {}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FILES = "(SELECT DISTINCT file_id, project_path, path, content_hash, language FROM file_payloads)"

_VECTORS = """WITH v AS (
  SELECT vec_id AS doc_id, '/corpus/dir' || (vec_id // 50) || '/file' || (vec_id // 5) AS file_path, ((vec_id % 5) * 10 + 1)::INTEGER AS start_line, ((vec_id % 5) * 10 + 9)::INTEGER AS end_line,
         ['go', 'java', 'python', 'rust', 'typescript'][(label % 5 + 1)::INTEGER] AS language, embedding FROM embeddings
), s AS (
  SELECT v.*, round(list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS score FROM v
)"""

ORACLE["cosine_topk"] = f"{_VECTORS} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10"
ORACLE["cosine_scores"] = ORACLE["cosine_scores_arrow"] = f"{_VECTORS} SELECT doc_id, score FROM s"
ORACLE["batch_topk"] = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 4) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10
"""

# the window a search stops at: the first of 2, 4, 8, 16 times the limit with enough files or without more rows
_ADAPTIVE = _VECTORS + """, r AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= {most}
), f AS (SELECT * FROM r WHERE {passes}), w AS (
  SELECT min(n) AS n FROM (
    SELECT n, (SELECT count(DISTINCT file_path) FROM f WHERE rank <= n * {per}) AS files, (SELECT count(*) FROM r WHERE rank <= n * {per}) AS raw
    FROM (VALUES ({limit} * 2), ({limit} * 4), ({limit} * 8), ({limit} * 16)) t(n))
  WHERE files >= {limit} OR raw < n OR n = {limit} * 16
), k AS (SELECT f.*, w.n::INTEGER AS "window" FROM f, w WHERE rank <= w.n * {per})"""
ORACLE["adaptive_window"] = _ADAPTIVE.format(most=480, passes="score >= 0.05", per=1, limit=30) + ' SELECT doc_id, file_path, score, rank, "window" FROM k'
_GROUPED = " SELECT file_path, arg_min(language, rank) AS language, max(score) AS best_score, count(*)::INTEGER AS n_matches FROM k GROUP BY file_path ORDER BY best_score DESC, file_path LIMIT 10"
ORACLE["semantic_search_files"] = _ADAPTIVE.format(most=160, passes="score >= 0.0", per=1, limit=10) + _GROUPED
ORACLE["semantic_search_filtered"] = (
    _ADAPTIVE.format(most=800, passes="score >= 0.01 AND (contains(file_path, 'dir1') OR contains(file_path, 'dir3') OR contains(file_path, 'dir5')) AND NOT contains(file_path, 'file12')", per=5, limit=10) + _GROUPED
)
ORACLE["fanout_2_langs"] = f"{_VECTORS} SELECT doc_id, language, score, row_number() OVER (PARTITION BY language ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE language IN ('go', 'java') QUALIFY rank <= 20"
ORACLE["postfilter_5_langs"] = f"{_VECTORS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 50) SELECT doc_id, language, score, rank FROM r WHERE score >= 0.05 AND language IN ('go', 'java', 'python')"

ORACLE["dedup_location"] = """
SELECT search_id, file_path, start_line, end_line, score, hit_id FROM search_hits WHERE file_path IS NOT NULL AND score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY search_id, file_path, start_line, end_line ORDER BY score DESC, hit_id) = 1
"""
ORACLE["path_filters"] = """
SELECT hit_id, file_path, score FROM search_hits WHERE file_path IS NOT NULL AND score >= 0.4
AND (contains(file_path, '/src/') OR contains(file_path, '/lib/') OR contains(file_path, '/core/')) AND NOT (contains(file_path, 'legacy') OR contains(file_path, 'vendor'))
"""
ORACLE["hits_by_file"] = """
SELECT search_id, file_path, max(score) AS best_score, count(*) AS hits, arg_min_null(language, hit_id) AS language FROM search_hits
WHERE file_path IS NOT NULL AND score IS NOT NULL GROUP BY search_id, file_path
"""
ORACLE["p5_found"] = """
WITH r AS (
  SELECT search_id, file_path, start_line AS s, end_line AS e FROM search_hits WHERE file_path IS NOT NULL
  UNION ALL
  SELECT search_id, file_path, n.start_line, n.end_line
  FROM (SELECT search_id, file_path, unnest(nested_hits) AS n FROM search_hits WHERE file_path IS NOT NULL)
), o AS (
  SELECT *, max(e) OVER (PARTITION BY search_id, file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
  FROM (SELECT DISTINCT * FROM r WHERE s <= e)
), g AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY search_id, file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o
), p AS (
  SELECT search_id, file_path, k, min(s) AS s, max(e) AS e FROM g GROUP BY ALL
), q AS (
  SELECT *, lead(s) OVER (PARTITION BY search_id, file_path ORDER BY k) AS nx FROM p
)
SELECT search_id, file_path, 'period' AS kind, s AS start_line, e AS end_line FROM q
UNION ALL
SELECT search_id, file_path, 'gap', (e + 1)::INTEGER, (nx - 1)::INTEGER FROM q WHERE nx IS NOT NULL
"""

_SYMBOL = "SELECT symbol_id, name, kind, file_path, line FROM l WHERE level = (SELECT min(level) FROM l) ORDER BY name, file_path, line LIMIT {}"
_NAME = _FOLD.format("name")
ORACLE["symbol_cascade"] = f"WITH l AS (SELECT *, CASE WHEN {_NAME} LIKE 'token' THEN 1 WHEN {_NAME} LIKE 'token%' THEN 2 WHEN {_NAME} LIKE '%token%' THEN 3 END AS level FROM symbols) " + _SYMBOL.format(100)
ORACLE["symbol_cascade_prefix"] = f"WITH l AS (SELECT *, CASE WHEN {_NAME} LIKE 'fetch' THEN 1 WHEN {_NAME} LIKE 'fetch%' THEN 2 WHEN {_NAME} LIKE '%fetch%' THEN 3 END AS level FROM symbols WHERE kind IN ('function', 'method')) " + _SYMBOL.format(1000)
ORACLE["symbol_definitions"] = f"WITH l AS (SELECT *, CASE WHEN name = 'render%' THEN 1 WHEN {_NAME} LIKE 'render%' THEN 2 END AS level FROM symbols WHERE kind = 'method') " + _SYMBOL.format(1000)
ORACLE["symbols_by_language"] = "SELECT coalesce(nullif(language, ''), '(unknown)') AS language, count(*) AS symbols FROM symbols WHERE name <> '' GROUP BY 1"
ORACLE["latest_symbols"] = "SELECT symbol_id, file_id, name, kind, line FROM symbols QUALIFY row_number() OVER (PARTITION BY file_id, name, kind, line ORDER BY indexed_at DESC, symbol_id DESC) = 1"

def _map(pairs: str) -> str:
    return "MAP {" + ", ".join("'{}': '{}'".format(*x.split("=")) for x in pairs.split()) + "}"


def _list(words: str) -> str:
    return ", ".join(f"'{x}'" for x in words.split())


_BASE = "string_split(path, '/')[-1]"
_EXT = f"lower(regexp_extract({_BASE}, '(\\.[^.]*)$', 1))"
_LANGUAGE = f"coalesce({_map(_OF_NAME)}[{_BASE}], {_map(_OF_EXTENSION)}[{_EXT}])"
_CLIENT = f"{_map(_OF_EXTENSION_CLIENT)}[{_EXT}]"
_PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
_BUCKET = f"CASE WHEN len({_PARTS}) > 3 THEN array_to_string({_PARTS}[1:4], '/') WHEN len({_PARTS}) > 1 THEN array_to_string({_PARTS}[1:2], '/') END"
ORACLE["files_like"] = f"SELECT DISTINCT path AS file_path, {_LANGUAGE} AS language FROM file_payloads WHERE {_FOLD.format('path')} LIKE '%token%' ORDER BY file_path LIMIT 1000"
ORACLE["path_languages"] = f"SELECT DISTINCT path, {_LANGUAGE} AS language, {_CLIENT} AS client_language, {_EXT} AS ext, {_BUCKET} AS bucket FROM file_payloads"

_SKIPPED = _list(_NO_REFERENCES)
_REFERENCES = f"""WITH l AS (
  SELECT path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS ls FROM (SELECT DISTINCT path, language, content FROM file_payloads WHERE content IS NOT NULL))
), r AS (
  SELECT DISTINCT path, i, name FROM (SELECT path, i, unnest(regexp_extract_all(l, '[A-Za-z0-9_]+')) AS name FROM l) WHERE regexp_matches(name, '^[A-Za-z_]') AND length(name) >= 2 AND name NOT IN ({_SKIPPED})
)"""
ORACLE["reference_counts"] = f"{_REFERENCES} SELECT name, count(*) AS lines, count(DISTINCT path) AS files FROM (SELECT DISTINCT path, i, name FROM r) GROUP BY name"

ORACLE["sliding_window_chunks"] = """
WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
w AS (SELECT *, unnest(range(0, CASE WHEN n <= 4000 THEN 1 ELSE ceil((n - 4000) / 3500)::BIGINT + 1 END))::INTEGER AS idx FROM d),
c AS (SELECT doc_id, idx, array_slice(b, idx * 3500 + 1, least(idx * 3500 + 4000, n)) AS c, CASE WHEN idx = 0 THEN ''::BLOB ELSE array_slice(b, 1, idx * 3500) END AS p FROM w)
SELECT doc_id, idx, md5(c) AS content_md5, (1 + len(list_filter(regexp_extract_all(hex(p), '..'), lambda x: x = '0A')))::INTEGER AS start_line,
       (1 + len(list_filter(regexp_extract_all(hex(p), '..'), lambda x: x = '0A')) + len(list_filter(regexp_extract_all(hex(c), '..'), lambda x: x = '0A')))::INTEGER AS end_line FROM c
"""
ORACLE["gap_fill"] = """
WITH t AS (SELECT DISTINCT file_id, len(string_split(content, chr(10))) AS n FROM file_payloads WHERE content IS NOT NULL),
r AS (SELECT DISTINCT file_id, start_line AS s, end_line AS e FROM chunks WHERE chunk_type <> 'module' AND start_line <= end_line UNION ALL SELECT file_id, n + 1, n + 1 FROM t),
o AS (SELECT *, coalesce(max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM r)
SELECT o.file_id, (m + 1)::INTEGER AS start_line, (least(s, n + 1) - 1)::INTEGER AS end_line FROM o JOIN t USING (file_id) WHERE m + 1 <= least(s, n + 1) - 1
"""
_REL = "CASE WHEN starts_with(file_path, rtrim(project_path, '/') || '/') THEN substr(file_path, length(rtrim(project_path, '/')) + 2) ELSE file_path END"
ORACLE["embedding_texts"] = f"""
SELECT DISTINCT chunk_id, md5(CASE WHEN rel = '' THEN chunk_type || ': ' || content ELSE 'File: ' || rel || chr(10) || CASE WHEN coalesce(language, '') <> '' THEN 'Language: ' || language || chr(10) ELSE '' END
  || CASE WHEN chunk_type IN ('function', 'class', 'method', 'type') AND coalesce(symbol_name, '') <> '' THEN chunk_type || ': ' || symbol_name || chr(10) ELSE '' END || chr(10) || content END) AS with_path,
  md5(chunk_type || ': ' || content) AS plain
FROM (SELECT *, {_REL} AS rel FROM chunks WHERE content IS NOT NULL)
"""
ORACLE["token_windows"] = """
WITH d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, unnest(range(0, CASE WHEN len(i) + 2 <= 128 THEN 1 ELSE ceil(len(i) / 126)::BIGINT END)) AS k FROM d),
x AS (SELECT doc_id, k, CASE WHEN len(i) + 2 <= 128 THEN i ELSE i[k * 126 + 1 : (k + 1) * 126] END AS c FROM w)
SELECT doc_id, k::INTEGER AS window_no, (len(c) + 2)::INTEGER AS n, (coalesce(list_sum(c), 0) + 203)::BIGINT AS total FROM x
"""
ORACLE["mean_pool"] = """
SELECT label, (i - 1)::INTEGER AS i, round(avg(v::DOUBLE), 6) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i
"""

_STORED = f"""stored AS (
  SELECT path, CASE WHEN file_id % 7 = 0 THEN 'stale' ELSE content_hash END AS content_hash FROM {_FILES} WHERE file_id % 5 <> 0
  UNION ALL SELECT path || '.gone', content_hash FROM {_FILES} WHERE file_id % 11 = 0
)"""
ORACLE["hash_diff"] = f"""WITH f AS (SELECT * FROM {_FILES}), {_STORED}
SELECT coalesce(f.path, stored.path) AS path, CASE WHEN f.path IS NULL THEN 'deleted' WHEN stored.path IS NULL THEN 'new' WHEN f.content_hash = stored.content_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM f FULL OUTER JOIN stored ON f.path = stored.path"""
ORACLE["files_to_send"] = f"WITH {_STORED} SELECT file_id, path FROM {_FILES} f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = f.path AND s.content_hash = f.content_hash)"
ORACLE["files_to_delete"] = f"WITH {_STORED} SELECT path FROM stored s WHERE NOT EXISTS (SELECT 1 FROM {_FILES} f WHERE f.path = s.path)"
ORACLE["upsert_latest"] = "SELECT file_id, received_at, content_hash, size FROM file_payloads QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC, content_hash DESC) = 1"
ORACLE["indexable_files"] = "SELECT DISTINCT file_id, path FROM file_payloads WHERE octet_length(encode(content)) <= 524288 AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''"
ORACLE["cascade_delete"] = """
WITH gone AS (SELECT host_path FROM projects WHERE status = 'error' OR path_hash < '4')
SELECT project_path, count(*) AS rows, 'symbols' AS source FROM symbols WHERE project_path NOT IN (SELECT host_path FROM gone) GROUP BY project_path
UNION ALL SELECT project_path, count(*), 'chunks' FROM chunks WHERE project_path NOT IN (SELECT host_path FROM gone) GROUP BY project_path
"""
_STATS = """f AS (SELECT project_path, count(DISTINCT file_id) AS a FROM file_payloads GROUP BY 1), c AS (SELECT project_path, count(DISTINCT chunk_id) AS b FROM chunks GROUP BY 1), y AS (SELECT project_path, count(*) AS d FROM symbols GROUP BY 1),
st AS (SELECT project_path, coalesce(a, 0) AS total_files, coalesce(b, 0) AS total_chunks, coalesce(d, 0) AS total_symbols FROM f FULL OUTER JOIN c USING (project_path) FULL OUTER JOIN y USING (project_path))"""
ORACLE["project_stats"] = f"WITH {_STATS} SELECT *, '{{\"total_files\":' || total_files || ',\"total_chunks\":' || total_chunks || ',\"total_symbols\":' || total_symbols || '}}' AS stats FROM st"
ORACLE["dir_histogram"] = f"SELECT {_BUCKET} AS dir, count(*) AS file_count FROM {_FILES} GROUP BY 1 HAVING dir IS NOT NULL ORDER BY file_count DESC, dir LIMIT 10"
_HISTOGRAM = f"SELECT project_path, {_BUCKET} AS dir, count(*) AS file_count FROM {_FILES} GROUP BY 1, 2 HAVING dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY file_count DESC, dir) <= "
ORACLE["dir_histogram_by_project"] = _HISTOGRAM + "10"
ORACLE["project_languages"] = f"SELECT project_path, '[\"' || string_agg(l, '\",\"' ORDER BY l) || '\"]' AS languages FROM (SELECT DISTINCT project_path, {_LANGUAGE} AS l FROM file_payloads) WHERE l IS NOT NULL GROUP BY project_path"
ORACLE["project_summary"] = f"""WITH {_STATS}, top AS ({_HISTOGRAM} 1)
SELECT host_path AS project_path, status, coalesce(total_files, 0) AS total_files, coalesce(total_chunks, 0) AS total_chunks, coalesce(total_symbols, 0) AS total_symbols, dir AS top_dir, file_count AS top_files
FROM projects LEFT JOIN st ON st.project_path = host_path LEFT JOIN top ON top.project_path = host_path"""
ORACLE["file_batches"] = f"SELECT project_path, b AS batch_no, count(*) AS files, min(path) AS first_path FROM (SELECT *, (row_number() OVER (PARTITION BY project_path ORDER BY path) - 1) // 20 AS b FROM {_FILES}) GROUP BY 1, 2"
ORACLE["latest_run"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1"
ORACLE["backfill_hash"] = "SELECT host_path, CASE WHEN path_hash < '8' THEN sha1(host_path)[1:16] ELSE path_hash END AS path_hash FROM projects"
ORACLE["identities"] = "SELECT DISTINCT chunk_id, md5(file_path)[1:12] || ':' || start_line || '-' || end_line || ':0' AS doc_id, 'project_' || md5(project_path) AS collection, sha1(project_path)[1:16] AS project_hash, sha256(content) AS content_hash FROM chunks"

ORACLE["path_overlap"] = """
WITH d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS q FROM file_payloads), p AS (SELECT DISTINCT host_path AS p FROM projects)
SELECT p AS left_path, q AS right_path FROM p, d WHERE p <> q AND (starts_with(p, q || '/') OR starts_with(q, p || '/')) AND q <> ''
"""
ORACLE["longest_prefix_root"] = f"""
WITH r AS (SELECT host_path AS root FROM projects UNION SELECT regexp_extract(path, '^(/[^/]+/[^/]+/[^/]+/[^/]+)/', 1) FROM {_FILES} WHERE file_id % 3 = 0), f AS (SELECT DISTINCT path FROM file_payloads)
SELECT path, coalesce((SELECT arg_max(root, length(root)) FROM r WHERE root <> '' AND (f.path = root OR starts_with(f.path, root || '/'))), path) AS resolved FROM f
"""
_IN_DIRS = _list(_DIRS)
_IN_EXT = _list(_EXTENSIONS)
_RELP = "CASE WHEN starts_with(path, project_path || '/') THEN substr(path, length(project_path) + 2) ELSE path END"
ORACLE["watch_actions"] = f"""
SELECT DISTINCT rel, CASE WHEN rel = '.git/HEAD' THEN 'immediate' WHEN len(list_filter(ds, lambda x: x IN ({_IN_DIRS}) OR ends_with(x, '.egg-info'))) > 0 THEN 'drop' WHEN b IN ('.gitignore', '.indexignore', '.indexconfig.yaml') THEN 'full'
  WHEN ends_with(b, '~') OR starts_with(b, '.#') OR b = '4913' OR lower(regexp_extract(b, '(\\.[^.]*)$', 1)) IN ({_IN_EXT}) THEN 'drop' ELSE 'track' END AS action
FROM (SELECT rel, string_split(rel, '/')[-1] AS b, string_split(rel, '/')[:-2] AS ds FROM (SELECT {_RELP} AS rel FROM file_payloads))
"""
ORACLE["runtime_config"] = """
WITH t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 3)::INTEGER END AS db, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 2 * 7)::INTEGER END AS env FROM supplier)
SELECT id, coalesce(nullif(db, 0), nullif(env, 0), 8)::INTEGER AS value, CASE WHEN nullif(db, 0) IS NOT NULL THEN 'db' WHEN nullif(env, 0) IS NOT NULL THEN 'env' ELSE 'recommended' END AS source,
  coalesce(db, env, -1)::INTEGER AS gpu, CASE WHEN db IS NOT NULL THEN 'db' WHEN env IS NOT NULL THEN 'env' ELSE 'recommended' END AS gpu_source, CASE WHEN db IS NULL THEN 5 WHEN db = 0 THEN NULL ELSE db END::INTEGER AS patched FROM t
"""
ORACLE["drift_flag"] = "SELECT host_path, CASE WHEN indexed_with_model IS NULL THEN 'unknown' WHEN indexed_with_model <> (SELECT max(indexed_with_model) FROM projects) THEN 'stale' ELSE 'current' END AS drift FROM projects"
ORACLE["project_settings"] = """
SELECT host_path, coalesce(json_array_length(j -> 'exclude_patterns'), 0)::INTEGER AS patterns, coalesce((j ->> 'max_file_size')::BIGINT, 524288) AS max_file_size
FROM (SELECT host_path, CASE WHEN json_valid(settings) THEN settings::JSON END AS j FROM projects)
"""
ORACLE["owner_counts"] = """
SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS all_orders,
  (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer
"""
ORACLE["valid_keys"] = "SELECT o_custkey AS owner_id, count(*) AS keys FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_acctbal >= 0 GROUP BY 1"
ORACLE["scalar_functions"] = """
SELECT o_orderkey AS id, floor(o_totalprice / 1000 * 10 + 0.5) / 10 AS one, round(o_totalprice / 7, 4) AS four, (o_orderkey % 7) * 100.0::DOUBLE / 6 AS pct,
  least(CASE WHEN o_orderkey % 1500 - 100 <= 0 THEN 20 ELSE o_orderkey % 1500 - 100 END, 1000)::INTEGER AS lim, least(pow(2.0, o_orderkey % 9 + 1), 60.0)::DOUBLE AS backoff,
  CASE WHEN a < 60 THEN a || 's' WHEN a < 3600 THEN (a // 60) || 'm' WHEN a < 86400 THEN printf('%d.%dh', (a * 10 + 1800) // 36000, (a * 10 + 1800) // 3600 % 10) ELSE printf('%d.%dd', (a * 10 + 43200) // 864000, (a * 10 + 43200) // 86400 % 10) END AS age FROM (SELECT *, o_orderkey % 200000 AS a FROM orders)
"""

ORACLE["ema"] = """
WITH RECURSIVE e AS (SELECT event_type, avg(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS i FROM events GROUP BY event_type, ts::DATE),
r AS (SELECT event_type, 3.0::DOUBLE AS s, 0::BIGINT AS i FROM (SELECT DISTINCT event_type FROM e) UNION ALL SELECT r.event_type, r.s * 0.75 + e.v * 0.25, e.i FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_type, round(arg_max(s, i), 6) AS ema FROM r GROUP BY event_type
"""
ORACLE["percentile_nearest"] = """
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, p, value FROM e, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(p) WHERE i = floor(p * (n - 1) + 0.5)
"""
_RANKED = """r AS (SELECT search_id AS query, file_path AS item, max(score) AS s, count(*) AS n FROM search_hits WHERE file_path IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2),
a AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS x FROM r QUALIFY x <= 10), b AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY n DESC, item) AS y FROM r QUALIFY y <= 10)"""
ORACLE["rank_agreement"] = f"""
WITH {_RANKED}, m AS (SELECT query, item, x, y FROM a JOIN b USING (query, item)), c AS (SELECT query, count(*) AS n FROM m GROUP BY 1),
t AS (SELECT p.query, sum(sign(q.y - p.y)) AS s FROM m p JOIN m q ON p.query = q.query AND p.x < q.x GROUP BY 1), na AS (SELECT query, count(*) AS k FROM a GROUP BY 1), nb AS (SELECT query, count(*) AS k FROM b GROUP BY 1)
SELECT na.query, round(coalesce(n, 0) / (na.k + nb.k - coalesce(n, 0))::DOUBLE, 6) AS jaccard, round(coalesce(n, 0) / na.k::DOUBLE, 6) AS recall, CASE WHEN n >= 2 THEN round(s * 2.0::DOUBLE / (n * (n - 1)), 6) END AS tau
FROM na JOIN nb USING (query) LEFT JOIN c USING (query) LEFT JOIN t USING (query)
"""
ORACLE["eval_metrics"] = f"""
WITH h AS (SELECT search_id AS query, {_REL} AS rel, max(score) AS s FROM search_hits WHERE file_path IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, rel) AS rank FROM h),
q AS (SELECT query, ['concept', 'path_hint', 'identifier'][(query % 3 + 1)::INTEGER] AS category, sum(CASE WHEN rank <= 5 AND (starts_with(rel, 'src/') OR rel = 'lib' OR starts_with(rel, 'lib/') OR starts_with(rel, 'core/')) THEN 1 ELSE 0 END) AS e,
  sum(CASE WHEN rank <= 5 AND (rel = 'legacy' OR starts_with(rel, 'legacy/')) THEN 1 ELSE 0 END) AS a FROM r GROUP BY 1, 2)
SELECT category, count(*) AS queries, round(count_if(e > 0) * 100.0::DOUBLE / count(*), 6) AS hit_rate, round(count_if(a = 0) * 100.0::DOUBLE / count(*), 6) AS clean_rate, round(sum(e) * 100.0::DOUBLE / (5 * count(*)), 6) AS "precision" FROM q GROUP BY category
"""
ORACLE["cosine_parity"] = """
SELECT count(*) AS pairs, round(avg(c), 6) AS mean, round(min(c), 6) AS least FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
"""
ORACLE["debounce"] = """
WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 21600000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, k
"""
ORACLE["progress_events"] = "SELECT event_type AS run_id, count(*) AS events, count(nullif(event_id % 5, 0)) AS with_chunks, sum(nullif(event_id % 5, 0))::BIGINT AS chunks, 0::BIGINT AS messages, max('/p/' || event_id) AS last_path FROM events GROUP BY 1"

_REFS = """p AS (SELECT path, i, regexp_extract_all(l, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS ps FROM (
    SELECT path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS ls FROM (SELECT DISTINCT path, content FROM file_payloads WHERE {0}))) WHERE {1}),
n AS (SELECT path, i, ps, unnest(ps) AS name, unnest(range(1, len(ps) + 1)) AS k FROM p)"""
ORACLE["reference_search"] = f"""WITH {_REFS.format("contains(content, 'logger')", "contains(l, 'logger')")}
SELECT path AS file_path, i::INTEGER AS start_line, i::INTEGER AS end_line, 'reference' AS chunk_type, name AS symbol_name, coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: octet_length(encode(x)))), 0)::INTEGER AS col
FROM n WHERE name = 'logger' ORDER BY file_path, start_line, col LIMIT 1000"""
ORACLE["references_elsewhere"] = f"""WITH {_REFS.format("content IS NOT NULL", "true")}, r AS (SELECT path, i, name, k FROM n WHERE regexp_matches(name, '^[A-Za-z_]') AND length(name) >= 2 AND name NOT IN ({_SKIPPED}))
SELECT name, count(*) AS uses FROM r WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_path = r.path AND s.name = r.name AND s.line = r.i) GROUP BY name"""
ORACLE["overlap_merge"] = """
WITH RECURSIVE h AS (
  SELECT search_id, file_path, start_line AS s, end_line AS e, score, hit_id, coalesce(symbol_name, '') <> '' AS named FROM search_hits WHERE file_path IS NOT NULL AND score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY search_id, file_path, start_line, end_line ORDER BY score DESC, hit_id) = 1
), o AS (SELECT *, row_number() OVER (PARTITION BY search_id, file_path ORDER BY s - e, s, score DESC, hit_id) AS i FROM h WHERE s IS NOT NULL AND e IS NOT NULL),
m AS (SELECT search_id, file_path, max(i) AS m FROM o GROUP BY 1, 2),
f AS (
  SELECT search_id, file_path, 0::BIGINT AS i, []::STRUCT(s INTEGER, e INTEGER, named BOOLEAN, hit_id BIGINT, best DOUBLE, n INTEGER)[] AS ps FROM m
  UNION ALL
  SELECT search_id, file_path, i, CASE WHEN spot > 0 THEN list_transform(ps, lambda p, j: CASE WHEN j = spot THEN {'s': p.s, 'e': p.e, 'named': p.named, 'hit_id': p.hit_id, 'best': greatest(p.best, score), 'n': p.n + 1} ELSE p END)
    ELSE list_append(ps, {'s': s, 'e': e, 'named': named, 'hit_id': hit_id, 'best': score, 'n': 0::INTEGER}) END
  FROM (SELECT f.search_id, f.file_path, o.i, o.s, o.e, o.named, o.hit_id, o.score, f.ps, coalesce(list_position(list_transform(f.ps, lambda p: (p.s <= o.s AND p.e >= o.e AND (p.s <> o.s OR p.e <> o.e)) OR ((p.named OR o.named) AND (p.e + 1 = o.s OR o.e + 1 = p.s))), true), 0) AS spot
        FROM f JOIN o ON o.search_id = f.search_id AND o.file_path = f.file_path AND o.i = f.i + 1)
)
SELECT search_id, file_path, p.hit_id AS hit_id, p.s AS start_line, p.e AS end_line, p.best AS score, p.n AS absorbed FROM (SELECT f.search_id, f.file_path, unnest(ps) AS p FROM f JOIN m ON m.search_id = f.search_id AND m.file_path = f.file_path AND m.m = f.i)
UNION ALL SELECT search_id, file_path, hit_id, s, e, score, 0 FROM h WHERE s IS NULL OR e IS NULL
"""
ORACLE["oversize_split"] = """
WITH RECURSIVE c AS (SELECT * FROM chunks WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1),
l AS (SELECT chunk_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM (SELECT chunk_id, list_transform(string_split(content, chr(10)), lambda y: octet_length(encode(y))) AS ls FROM c WHERE octet_length(encode(content)) > 4500)),
f AS (
  SELECT chunk_id, 0::BIGINT AS i, 0::BIGINT AS spot, x::BIGINT AS b FROM l WHERE i = 0
  UNION ALL SELECT f.chunk_id, l.i, CASE WHEN f.b + 1 + l.x >= 4500 THEN l.i ELSE f.spot END, CASE WHEN f.b + 1 + l.x >= 4500 THEN l.x ELSE f.b + 1 + l.x END FROM f JOIN l ON l.chunk_id = f.chunk_id AND l.i = f.i + 1
), p AS (SELECT chunk_id, spot, max(i) AS z, max(b) AS b FROM f GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY spot) - 1 AS no, row_number() OVER (PARTITION BY chunk_id ORDER BY spot DESC) = 1 AS fin FROM p)
SELECT chunk_id, no::INTEGER AS piece_no, b::INTEGER AS bytes, (start_line + spot)::INTEGER AS start_line, CASE WHEN fin THEN end_line ELSE (start_line + z)::INTEGER END AS end_line, CASE WHEN no = 0 THEN chunk_type ELSE 'block' END AS chunk_type, CASE WHEN no = 0 THEN symbol_name END AS symbol_name FROM q JOIN c USING (chunk_id)
UNION ALL SELECT chunk_id, 0, octet_length(encode(content))::INTEGER, start_line, end_line, chunk_type, symbol_name FROM c WHERE octet_length(encode(content)) <= 4500
"""
_SECONDS = "t AS (SELECT user_id AS k, epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE AS t, event_type AS p, event_id FROM events)"
ORACLE["debounce_capped"] = f"""
WITH RECURSIVE {_SECONDS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, p) AS i FROM t),
f AS (
  SELECT k, i, t, p, t AS first, 1::BIGINT AS s, false AS whole FROM o WHERE i = 1
  UNION ALL SELECT k, i, t, p, first, s, t - first >= 86400 FROM (SELECT o.k, o.i, o.t, o.p, CASE WHEN f.whole OR o.t - f.t >= 21600 THEN o.t ELSE f.first END AS first, CASE WHEN f.whole OR o.t - f.t >= 21600 THEN f.s + 1 ELSE f.s END AS s FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
)
SELECT k AS user_id, CASE WHEN bool_or(whole) THEN max(t) ELSE max(t) + 21600 END AS flushed_at, count(*)::INTEGER AS events, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM f GROUP BY k, s
"""
ORACLE["rate_limit"] = f"""
WITH RECURSIVE {_SECONDS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS i FROM t),
f AS (
  SELECT k, i, t, event_id, [t] AS l, true AS allowed, 0::DOUBLE AS retry FROM o WHERE i = 1
  UNION ALL SELECT k, i, t, event_id, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END, len(l) < 3, CASE WHEN len(l) < 3 THEN 0 ELSE greatest(86400.0::DOUBLE - (t - l[1]), 1.0::DOUBLE) END
  FROM (SELECT o.k, o.i, o.t, o.event_id, list_filter(f.l, lambda x: x >= o.t - 86400) AS l FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
)
SELECT k AS user_id, event_id AS attempt_id, t, allowed, retry AS retry_after FROM f
"""
ORACLE["run_coalesce"] = f"""
WITH RECURSIVE {_SECONDS}, o AS (SELECT k, t, p = 'purchase' AS whole, row_number() OVER (PARTITION BY k ORDER BY t, p = 'purchase') AS i FROM t),
f AS (
  SELECT k, i, t AS run, whole, t + 28800 AS e, false AS pending FROM o WHERE i = 1
  UNION ALL SELECT k, i, CASE WHEN e <= t THEN t ELSE e END, whole, CASE WHEN e <= t THEN t + 28800 ELSE e END, e > t FROM (SELECT o.k, o.i, o.t, o.whole, CASE WHEN f.pending AND f.e <= o.t THEN f.e + 28800 ELSE f.e END AS e FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
)
SELECT k AS user_id, run AS started_at, bool_or(whole) AS "full", count(*)::INTEGER AS requests FROM f GROUP BY k, run
"""
ORACLE["index_finish"] = f"""
WITH h AS (SELECT * FROM {_FILES} WHERE file_id % 5 <> 0), g AS (SELECT path FROM file_payloads WHERE file_id % 5 = 0),
l AS (SELECT project_path, '["' || string_agg(l, '","' ORDER BY l) || '"]' AS languages FROM (SELECT DISTINCT project_path, {_LANGUAGE} AS l FROM h) WHERE l IS NOT NULL GROUP BY 1)
SELECT project_path, count(*) AS indexed_files, (SELECT count(DISTINCT chunk_id) FROM chunks c WHERE c.project_path = h.project_path AND c.file_path NOT IN (SELECT path FROM g)) AS total_chunks,
  (SELECT count(*) FROM symbols s WHERE s.project_path = h.project_path AND s.file_path NOT IN (SELECT path FROM g)) AS total_symbols, any_value(l.languages) AS languages FROM h LEFT JOIN l USING (project_path) GROUP BY project_path
"""
ORACLE["project_details"] = f"""
WITH t AS ({_HISTOGRAM} 10), d AS (SELECT project_path, string_agg(dir || ':' || file_count, ',' ORDER BY file_count DESC, dir) AS directories FROM t GROUP BY 1),
y AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY file_path, line, name, symbol_id) <= 20), s AS (SELECT project_path, string_agg(file_path || ':' || line || ':' || name, ',' ORDER BY file_path, line, name, kind) AS symbols FROM y GROUP BY 1)
SELECT host_path AS project_path, status, coalesce(languages, '[]') AS languages, (SELECT count(*) FROM {_FILES} f WHERE f.project_path = host_path) AS total_files, (SELECT count(*) FROM symbols x WHERE x.project_path = host_path) AS total_symbols, coalesce(directories, '') AS directories, coalesce(s.symbols, '') AS symbols
FROM projects LEFT JOIN d ON d.project_path = host_path LEFT JOIN s ON s.project_path = host_path
"""
