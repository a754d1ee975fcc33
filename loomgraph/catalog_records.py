"""Registered queries over records, requests and semantic plans, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import SQL, plain, query
from .functions import ids
from .operators import activation, analyzers, compile, intents, ir, merge, org, records, search
from .plans import index, order
from .sources import seeds, syntax
from .sources.tables import graph, table

# -- record tables ----------------------------------------------------------------------------------------------------------


def _iir(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    row = lambda kind: o.select(F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("project_id"), F.col("o_orderkey").alias("node_id"), F.lit(kind).alias("kind"))
    return row("intended").where("node_id % 3 = 0").unionByName(row("extracted"))


IIR = "WITH iir AS (SELECT 'p'||(o_custkey % 7) AS project_id, o_orderkey AS node_id, k AS kind FROM orders, (VALUES ('intended'), ('extracted')) v(k) WHERE k = 'extracted' OR o_orderkey % 3 = 0)"


@plain(f"{IIR} SELECT project_id, node_id, kind, row_number() OVER (PARTITION BY project_id, node_id ORDER BY kind) AS place FROM iir WHERE node_id % 2 = 0")
def intents_by_node(spark, sf):
    i = _iir(spark, sf)
    return records.intents_of_nodes(i, i.where("node_id % 2 = 0"))


@plain(f"{IIR} SELECT project_id, node_id, kind, row_number() OVER (PARTITION BY project_id ORDER BY node_id) AS place FROM iir WHERE kind = 'intended' AND project_id <> 'p3'")
def intents_by_project(spark, sf):
    i = _iir(spark, sf)
    return records.intents_of_projects(i, i.where("kind = 'intended' and project_id <> 'p3'"))


@plain(f"{IIR} SELECT project_id, node_id, kind FROM iir WHERE kind = 'intended' AND node_id % 5 = 0")
def intent_lookup(spark, sf):
    i = _iir(spark, sf)
    return records.intent_row(i, i.where("node_id % 5 = 0").withColumn("kind", F.lit("intended")))


LOG = "WITH log AS (SELECT event_id AS id, 'r'||(user_id % 20) AS run_id, 's'||(user_id % 9) AS session_id, event_id % 4 AS loop_index, ts, value FROM events)"


def _log(spark, sf) -> DataFrame:
    k = F.col("user_id")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("r"), k % 20).alias("run_id"), F.concat(F.lit("s"), k % 9).alias("session_id"), (F.col("event_id") % 4).alias("loop_index"), "ts", "value")


@plain(f"{LOG} SELECT id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY loop_index, ts, id) AS place FROM log WHERE run_id IN ('r1', 'r7', 'r12')")
def execution_log_by_run(spark, sf):
    return records.log_of_runs(_log(spark, sf), spark.createDataFrame([("r1",), ("r7",), ("r12",), ("none",)], "run_id string")).select("id", "run_id", "place")


@plain(f"{LOG} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS place FROM log WHERE session_id IN ('s2', 's5')")
def execution_log_by_session(spark, sf):
    return records.log_of_sessions(_log(spark, sf), spark.createDataFrame([("s2",), ("s5",)], "session_id string")).select("id", "session_id", "place")


@plain("""WITH e AS (SELECT event_id AS id, 'r'||(user_id % 20) AS run_id, 'n'||(event_id % 50) AS entity_id, event_id % 4 AS loop_index, ts AS created_at FROM events)
SELECT 'run' AS by, id, row_number() OVER (PARTITION BY run_id ORDER BY loop_index, created_at, id) AS place FROM e WHERE run_id IN ('r3', 'r4') UNION ALL SELECT 'entity', id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, id) FROM e WHERE entity_id = 'n7'""")
def enrichment_scans(spark, sf):
    rows = _log(spark, sf).select("id", "run_id", F.concat(F.lit("n"), F.col("id") % 50).alias("entity_id"), "loop_index", F.col("ts").alias("created_at"))
    runs = records.enrichments_of_runs(rows, spark.createDataFrame([("r3",), ("r4",)], "run_id string"))
    one = records.enrichments_of_entities(rows, spark.createDataFrame([("n7",)], "entity_id string"))
    return runs.select(F.lit("run").alias("by"), "id", "place").unionByName(one.select(F.lit("entity").alias("by"), "id", "place"))


@plain("""WITH p AS (SELECT s_suppkey AS id, 'git@h:'||s_name AS git_url, s_nationkey AS last_seen_at FROM supplier), paths AS (SELECT s_suppkey AS project_id, '/src/'||n AS path, s_nationkey + n AS last_seen FROM supplier, range(3) r(n) WHERE s_suppkey % 3 >= n)
SELECT 'path' AS by, id::VARCHAR||':'||path AS key, 0 AS place FROM p JOIN paths ON project_id = id WHERE path IN ('/src/1', '/src/9') UNION ALL SELECT 'url', id::VARCHAR, 0 FROM p WHERE git_url LIKE '%1'
UNION ALL SELECT 'paths', project_id::VARCHAR||':'||path, row_number() OVER (PARTITION BY project_id ORDER BY last_seen DESC, path) FROM paths WHERE project_id < 5""")
def project_registry(spark, sf):
    s = table(spark, sf, "supplier")
    projects = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("git@h:"), "s_name").alias("git_url"), F.col("s_nationkey").alias("last_seen_at"))
    paths = s.select(F.col("s_suppkey").alias("project_id"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.col("s_suppkey") % 3)).alias("n")).select("project_id", F.concat(F.lit("/src/"), "n").alias("path"), (F.col("s_nationkey") + F.col("n")).alias("last_seen"))
    by_path = records.projects_by_path(projects, paths, spark.createDataFrame([("/src/1",), ("/src/9",)], "path string"))
    by_url = records.projects_by(projects, projects.where("git_url like '%1'"), "git_url")
    listed = records.project_paths(paths, projects.where("id < 5").withColumnRenamed("id", "project_id"))
    shown = lambda df, by, key, place: df.select(F.lit(by).alias("by"), key.alias("key"), place.cast("int").alias("place"))
    out = shown(by_path, "path", F.concat_ws(":", "id", "path"), F.lit(0)).unionByName(shown(by_url, "url", F.col("id").cast("string"), F.lit(0)))
    return out.unionByName(shown(listed, "paths", F.concat_ws(":", "project_id", "path"), F.col("place")))


@plain("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 <> 0 AND (c_custkey % 4 = 0 OR c_custkey > 40)")
def live_tokens(spark, sf):
    k = F.col("c_custkey")
    tokens = table(spark, sf, "customer").select(k.alias("id"), F.sha2(F.concat(F.lit("t"), k), 256).alias("token_hash"), F.when(k % 5 == 0, k).alias("revoked_at"), F.when(k % 4 != 0, k).alias("expires_at"))
    return records.live_tokens(tokens, tokens.where("id % 3 > 0"), 40).select("id")


@plain("""WITH s AS (SELECT p_brand AS term, CASE p_size % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'project' ELSE 'own' END AS scope, CASE WHEN p_size % 3 = 2 THEN 'p'||(p_partkey % 4) END AS owner, p_name AS definition FROM part),
w AS (SELECT DISTINCT 'p'||(p_partkey % 4) AS project_id, p_brand AS term FROM part), h AS (SELECT w.project_id, w.term, scope, definition, row_number() OVER (PARTITION BY w.project_id, w.term ORDER BY CASE WHEN owner = w.project_id THEN 0 WHEN scope = 'project' THEN 1 ELSE 2 END, owner NULLS FIRST, definition) AS place
FROM w JOIN s ON s.term = w.term AND (owner = w.project_id OR scope IN ('project', 'org'))) SELECT project_id, term, scope, definition FROM h WHERE place = 1""")
def seed_lookup(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_size") % 3
    rows = p.select(F.col("p_brand").alias("term"), F.when(k == 0, "org").when(k == 1, "project").otherwise("own").alias("scope"), F.when(k == 2, F.concat(F.lit("p"), F.col("p_partkey") % 4)).alias("project_id"), F.col("p_name").alias("definition"))
    return records.seed_by_term(rows, p.select(F.concat(F.lit("p"), F.col("p_partkey") % 4).alias("project_id"), F.col("p_brand").alias("term")))


@plain("SELECT 'f'||l_suppkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def owner_counts(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rel_path"), F.concat(F.lit("f"), "l_suppkey").alias("id")).distinct()
    return records.owner_counts(x)


@plain("""WITH v AS (SELECT user_id AS artifact_id, event_type AS verdict, ts, event_id FROM events), b AS (SELECT artifact_id, arg_max(verdict, event_id) AS v FROM v WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT artifact_id, arg_max(verdict, event_id) AS v FROM v WHERE event_id % 3 = 0 GROUP BY 1)
SELECT coalesce(a.artifact_id, b.artifact_id) AS artifact_id, coalesce(b.v, '') AS before, coalesce(a.v, '') AS after FROM a FULL JOIN b ON a.artifact_id = b.artifact_id WHERE coalesce(b.v, '') <> coalesce(a.v, '')""")
def verdict_changes(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("artifact_id"), F.col("event_type").alias("verdict"), F.lit(0).alias("created_at"), F.col("event_id").alias("id"))
    return records.verdict_changes(v.where("id % 2 = 0"), v.where("id % 3 = 0"))


@plain("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ended' ELSE 'open' END AS status, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_nationkey END AS ended_at FROM customer")
def session_updates(spark, sf):
    k = F.col("c_custkey")
    old = table(spark, sf, "customer").select(k.alias("id"), F.lit("open").alias("status"), F.lit(None).cast("long").alias("ended_at"), "c_nationkey")
    changes = old.where("id % 3 = 0").select("id", F.lit("ended").alias("status"), F.when(F.col("id") % 6 != 0, F.col("c_nationkey")).cast("long").alias("ended_at")).unionByName(spark.createDataFrame([(-1, "ended", 0)], "id long, status string, ended_at long"))
    return records.update(old.drop("c_nationkey"), changes, ["id"])


@plain("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 0 ELSE l_partkey END AS line_start, CASE WHEN l_linenumber % 4 = 0 OR l_partkey = 0 THEN 0 WHEN l_linenumber % 4 = 1 THEN l_partkey + 5 ELSE l_partkey END AS line_end FROM lineitem")
def line_ranges(spark, sf):
    k, p = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    end = (F.col("l_partkey") + 5).cast("string")
    text = F.when(k == 0, '{"line_end": 7}').when(k == 1, F.concat(F.lit('{"line_start": '), p, F.lit('.0, "line_end": "'), end, F.lit('"}'))).when(k == 2, F.concat(F.lit('{"start_line": "'), p, F.lit('", "end_line": 0}'))).otherwise(F.concat(F.lit('{"start_line": '), p, F.lit("}")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", records.line_range(text).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


# -- requests ---------------------------------------------------------------------------------------------------------------


def _requests(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.concat(F.lit("<mode> "), F.when(k % 4 == 0, "direct").when(k % 4 == 1, "odd").otherwise("thinking"), F.lit(" </mode> said <anchors>"))
    one = F.concat(F.lit('<anchor type="'), F.when(k % 3 == 0, "symbol").when(k % 3 == 1, "concept").otherwise("place"), F.lit('" id="A'), k, F.lit('" confidence="'), F.when(k % 2 == 0, "low").otherwise("sure"), F.lit('"/>'))
    two = F.when(k % 5 == 0, '<anchor id="C" type="concept">').otherwise("")
    rest = F.concat(F.lit('</anchors><predicate name="summary" value="'), F.when(k % 7 == 0, "true").otherwise("no"), F.lit('"/><open_queries><open_query> why </open_query><open_query> </open_query></open_queries><max_loops>'), k % 30, F.lit("</max_loops><k_limit>"), k % 200, F.lit("</k_limit>"))
    return ir.extract(table(spark, sf, "orders").select(k.alias("id"), F.concat(head, one, two, rest).alias("text")))


REQUESTS = """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'direct' ELSE 'thinking' END AS mode, CASE o_orderkey % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'concept' END AS one, CASE WHEN o_orderkey % 2 = 0 THEN 'low' ELSE 'sure' END AS sure, o_orderkey % 5 = 0 AS two, o_orderkey % 7 = 0 AS summary,
least(20, greatest(1, o_orderkey % 30)) AS loops, least(100, greatest(10, o_orderkey % 200)) AS k FROM orders)"""


@plain(f"{REQUESTS} SELECT id, mode, concat_ws(',', one||':A'||id||':'||sure, CASE WHEN two THEN 'concept:C:medium' END) AS anchors, CASE WHEN summary THEN 'true' ELSE 'no' END AS summary, 'why' AS asked, loops::INT AS max_loops, k::INT AS k_limit FROM o")
def request_extract(spark, sf):
    shown = F.array_join(F.transform("anchors", lambda a: F.concat_ws(":", a["type"], a["id"], a["confidence"])), ",")
    return _requests(spark, sf).select("id", "mode", shown.alias("anchors"), F.col("predicates")["summary"].alias("summary"), F.array_join("open_queries", "|").alias("asked"), "max_loops", "k_limit")


@plain(f"""{REQUESTS} SELECT id, CASE WHEN one IS NULL AND NOT two THEN 'no anchors' END AS error, concat_ws(',', CASE WHEN one IS NOT NULL THEN CASE WHEN sure = 'low' THEN 'low' ELSE 'medium' END END, CASE WHEN two THEN 'medium' END) AS sure,
concat_ws(',', CASE WHEN one = 'symbol' AND sure <> 'low' THEN 'callgraph' END, CASE WHEN mode = 'thinking' AND one = 'symbol' THEN 'references' END, CASE WHEN one = 'concept' OR two THEN 'concepts' END, CASE WHEN one = 'concept' AND two THEN 'crossproject' END, CASE WHEN summary THEN 'summary' END) AS tools FROM o""")
def request_tools(spark, sf):
    rows = ir.tools(ir.validate(_requests(spark, sf)))
    return rows.select("id", "error", F.array_join(F.transform("anchors", lambda a: a["confidence"]), ",").alias("sure"), F.array_join("tools", ",").alias("tools"))


@plain("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'context.gutenberg,output.html' END AS tags, CASE WHEN o_orderkey % 3 = 0 THEN 'what.ever' ELSE '' END AS unknown FROM orders")
def semantic_tags(spark, sf):
    k = F.col("o_orderkey")
    given = F.array(F.lit(" output.html"), F.lit("context.gutenberg "), F.lit("output.html"), F.lit(""), F.when(k % 3 == 0, "what.ever").otherwise(""))
    return table(spark, sf, "orders").select(k.alias("id"), ir.normal_tags(given).alias("t")).select("id", F.array_join("t.tags", ",").alias("tags"), F.array_join("t.unknown", ",").alias("unknown"))


@plain("SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN text END AS whole, strlen(text) > 2000 AS cut FROM documents WHERE text IS NOT NULL")
def truncated_contents(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", ir.truncated(F.col("text")).alias("t"))
    return d.select("doc_id", F.when(F.octet_length("text") <= 2000, F.col("t")).alias("whole"), F.endswith(F.col("t"), F.lit("\n_(content truncated at 2000 chars)_")).alias("cut"))


# -- plug-ins, extraction ---------------------------------------------------------------------------------------------------


PLUGINS = [
    order.Plugin("convention", extensions=(".TS",), match=order.glob_match("api/*"), enriches=("typescript",)),
    order.Plugin("types", extensions=(".ts", ".tsx"), provides=("language:typescript",)),
    order.Plugin("python", extensions=(".py",), provides=("language:python",)),
]


@plain("""WITH f AS (SELECT ['api', 'src'][p_partkey % 2 + 1]||'/f'||p_partkey||['.ts', '.py', '.go', '.TSX'][p_size % 4 + 1] AS rel_path FROM part)
SELECT rel_path, 'convention' AS plugin FROM f WHERE rel_path LIKE 'api/%' OR lower(rel_path) LIKE '%.ts' UNION ALL SELECT rel_path, 'types' FROM f WHERE lower(rel_path) LIKE '%.ts' OR lower(rel_path) LIKE '%.tsx' UNION ALL SELECT rel_path, 'python' FROM f WHERE rel_path LIKE '%.py'""")
def plugin_match(spark, sf):
    path = F.concat(F.element_at(F.array(F.lit("api"), F.lit("src")), (F.col("p_partkey") % 2 + 1).cast("int")), F.lit("/f"), "p_partkey", F.element_at(F.lit([".ts", ".py", ".go", ".TSX"]), (F.col("p_size") % 4 + 1).cast("int")))
    return order.matched_files(table(spark, sf, "part").select(path.alias("rel_path")), PLUGINS)


@plain("""WITH p AS (SELECT s_suppkey AS ord, 'x'||s_suppkey AS provider, ['extractor', 'emitter'][s_suppkey % 2 + 1] AS kind, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'l'||(s_nationkey % 4) END AS lang FROM supplier), w AS (SELECT DISTINCT 'l'||(n_nationkey % 6) AS language, k AS kind FROM nation, (VALUES ('extractor'), ('emitter'), ('none')) v(k))
SELECT language, w.kind, arg_max(provider, ord) AS provider FROM w JOIN p ON p.kind = w.kind AND (lang IS NULL OR lang = language) GROUP BY 1, 2""")
def provider_precedence(spark, sf):
    k = F.col("s_suppkey")
    providers = table(spark, sf, "supplier").select(F.concat(F.lit("x"), k).alias("provider"), k.alias("ord"), F.when(k % 2 == 0, "extractor").otherwise("emitter").alias("kind"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("l"), F.col("s_nationkey") % 4))).alias("languages"))
    wanted = table(spark, sf, "nation").select(F.concat(F.lit("l"), F.col("n_nationkey") % 6).alias("language"), F.explode(F.array(F.lit("extractor"), F.lit("emitter"), F.lit("none"))).alias("kind")).distinct()
    return order.provider_for(providers, wanted)


@plain("""WITH n AS (SELECT 'f'||p_size AS rel_path, 'l'||p_partkey AS local_id, substr(sha256('p:symbol:c'||p_partkey), 1, 32) AS id FROM part),
e AS (SELECT rel_path, local_id AS s, CASE WHEN p_partkey % 2 = 0 THEN 'sib'||p_size ELSE 'ext' END AS t FROM part JOIN n ON local_id = 'l'||p_partkey)
SELECT e.rel_path, n.id AS source_id, CASE WHEN t LIKE 'sib%' THEN upper(t) ELSE t END AS target_id, substr(sha256(n.id||':calls:'||CASE WHEN t LIKE 'sib%' THEN upper(t) ELSE t END), 1, 32) AS id FROM e JOIN n ON n.local_id = s""")
def edge_remap(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("f"), "p_size").alias("rel_path"), F.concat(F.lit("l"), "p_partkey").alias("local_id"), F.lit("symbol").alias("type"), F.concat(F.lit("c"), "p_partkey").alias("canonical_id"), "p_partkey", "p_size")
    edges = p.select("rel_path", F.col("local_id").alias("source_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sib"), "p_size")).otherwise("ext").alias("target_id"), F.lit("calls").alias("type"))
    siblings = p.select("rel_path", F.concat(F.lit("sib"), "p_size").alias("local_id"), F.concat(F.lit("SIB"), "p_size").alias("id")).distinct()
    return merge.remapped(p.drop("p_partkey", "p_size"), edges, "p", siblings)[1].select("rel_path", "source_id", "target_id", "id")


@query("""SELECT n.id, n.canonical_id, a.activation, CASE WHEN a.activation >= 0.8 THEN 'high' WHEN a.activation >= 0.56 THEN 'medium' ELSE 'low' END AS confidence,
(SELECT count(*) FROM edges e WHERE e.source_id = n.id) + (SELECT count(*) FROM edges e WHERE e.target_id = n.id AND e.source_id <> n.id) AS edges FROM acts a JOIN nodes n ON n.id = a.node_id WHERE a.activation > 0.3""")
def anchor_enrichment(spark, sf):
    g = graph(spark, sf)
    found = g.activation.where("activation > 0.3").withColumnRenamed("node_id", "id").unionByName(spark.createDataFrame([("gone", 1.0)], "id string, activation double"))
    return activation.enriched(g, found).select("id", "canonical_id", "activation", "confidence", F.size("edges").cast("long").alias("edges"))


@query("""SELECT 'node' AS what, id FROM nodes WHERE NOT (type = 'concept' OR (type = 'file' AND substr(id, 1, 1) < '8')) UNION ALL
SELECT 'edge', e.id FROM edges e WHERE e.type <> 'imports' AND e.source_id NOT IN (SELECT id FROM nodes WHERE type = 'concept' OR (type = 'file' AND substr(id, 1, 1) < '8')) AND e.target_id NOT IN (SELECT id FROM nodes WHERE type = 'concept' OR (type = 'file' AND substr(id, 1, 1) < '8'))
UNION ALL SELECT 'intent', id FROM nodes WHERE type = 'symbol'""")
def legacy_sweep(spark, sf):
    g = graph(spark, sf)
    run = lambda stale: F.when(stale, F.lit(None).cast("string")).otherwise("r2")
    nodes = g.nodes.withColumns({"index_managed": F.col("type") != "namespace", "last_index_run_id": run((F.col("type") == "concept") | (F.col("type") == "namespace") | ((F.col("type") == "file") & (F.substring("id", 1, 1) < "8")))})
    edges = g.edges.withColumns({"index_managed": F.lit(True), "last_index_run_id": F.when(F.col("type") == "imports", "r1").otherwise("r2")})
    iir = g.nodes.where("type in ('symbol', 'concept')").select(F.col("id").alias("node_id"), F.lit("extracted").alias("kind"))
    a, b, c = merge.swept(nodes, edges, iir, "r2", g.derived)
    shown = lambda df, what, key: df.select(F.lit(what).alias("what"), F.col(key).alias("id"))
    return shown(a, "node", "id").unionByName(shown(b, "edge", "id")).unionByName(shown(c, "intent", "node_id"))


@plain("SELECT p_partkey AS rel_path, least(1024, greatest(1, ceil(greatest(p_size * 1000, 1) * 16 * 3 / 65536)))::BIGINT AS units FROM part")
def admission_units(spark, sf):
    return index.admitted(table(spark, sf, "part").select(F.col("p_partkey").alias("rel_path"), (F.col("p_size") * 1000).alias("length")), 2).select("rel_path", "units")


@plain("""SELECT s_suppkey AS id, c AS concept FROM supplier, (VALUES ('abstract'), ('dataclass'), ('exception'), ('context-manager')) v(c)
WHERE (c = 'abstract' AND s_nationkey % 4 = 0) OR (c = 'dataclass' AND s_suppkey % 3 = 0) OR (c = 'exception' AND s_nationkey % 4 = 1) OR (c = 'context-manager' AND s_nationkey % 2 = 0)""")
def class_concepts(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    base = F.when(n % 4 == 0, "abc.ABCMeta").when(n % 4 == 1, "lib.ValueError").otherwise("object")
    classes = table(spark, sf, "supplier").select(k.alias("id"), F.concat(F.lit("f"), n).alias("source_file"), F.array(F.lit("Plain"), base).alias("bases"), F.when(k % 3 == 0, F.array(F.lit("dataclasses.dataclass(frozen=True)"))).otherwise(F.array().cast("array<string>")).alias("decorators"))
    methods = table(spark, sf, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("source_file"), F.lit("method").alias("kind"), F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("A.__enter__"), F.lit("__exit__"))).otherwise(F.array(F.lit("__enter__"), F.lit("exit__")))).alias("label"))
    return analyzers.class_concepts(classes, methods)


@plain("SELECT p_partkey AS id, 'component' AS concept FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 4 < 3")
def react_components(spark, sf):
    k = F.col("p_partkey")
    symbols = table(spark, sf, "part").select(k.alias("id"), F.when(k % 4 == 3, "part_X").otherwise("Part1").alias("label"), F.when(k % 2 == 0, "class").otherwise("function").alias("kind"), (k % 3 > 0).alias("exported"), F.when(F.col("p_size") % 2 == 0, "a/b.tsx").otherwise("a/b.ts").alias("source_file"))
    return analyzers.react_components(symbols)


@plain("""WITH c AS (SELECT event_id, ['Get', 'noop', 'trackAll'][event_id % 3 + 1] AS method, ['', 'axios', 'logger', 'x'][event_id % 4 + 1] AS root, ['', 'net/http/cookie', 'database/sql', 'iota', 'os'][event_id % 5 + 1] AS path FROM events)
SELECT event_id, CASE WHEN path = 'net/http/cookie' THEN 'network' WHEN path = 'database/sql' THEN 'db' WHEN path = 'os' THEN 'io' WHEN root = 'axios' THEN 'network' WHEN root = 'logger' THEN 'log' WHEN method = 'trackAll' THEN 'mutation' ELSE 'unclassified' END AS kind,
CASE WHEN path IN ('net/http/cookie', 'database/sql', 'os') OR root IN ('axios', 'logger') THEN 'resolved' ELSE 'heuristic' END AS basis FROM c""")
def call_effects(spark, sf):
    pick = lambda xs: F.element_at(F.lit(xs), (F.col("event_id") % len(xs) + 1).cast("int"))
    e = ids.call_effect(pick(["Get", "noop", "trackAll"]), pick(["", "axios", "logger", "x"]), pick(["", "net/http/cookie", "database/sql", "iota", "os"]))
    return table(spark, sf, "events").select("event_id", e.alias("e")).select("event_id", "e.*")


@plain("SELECT * FROM (VALUES ('go', 10, 'channel', 'struct'), ('python', 10, 'abstract', 'type-hint'), ('typescript', 8, 'async-await', 'server-component')) v(language, n, first, last)")
def language_concepts(spark, sf):
    return seeds.concept_seeds(spark).groupBy("language").agg(F.count("*").cast("int").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


@plain("SELECT 'm'||p_partkey||'.py' AS rel_path, 9 AS nodes, 2 AS calls, 1 AS own_calls, 'f'||p_partkey AS first FROM part")
def syntax_walks(spark, sf):
    text = F.concat(F.lit("def f"), "p_partkey", F.lit("():\n    g()\n    def h():\n        k()\n"))
    files = table(spark, sf, "part").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("rel_path"), F.lit("python").alias("language"), text.alias("content"))
    nodes = syntax.laid_out(files)
    roots = nodes.where("type = 'FunctionDef' and parent = 0")
    count = lambda df, name: df.groupBy("rel_path").agg(F.sum((F.col("type") == "Call").cast("int")).cast("int").alias(name)).hint("merge")
    found = nodes.where("type not in ('arguments', 'Load')").groupBy("rel_path").agg(F.count("*").cast("int").alias("nodes"))
    own = count(syntax.below(nodes, roots, True), "own_calls")
    return found.join(count(syntax.below(nodes, roots), "calls"), "rel_path").join(own, "rel_path").join(roots.select("rel_path", F.col("name").alias("first")).hint("merge"), "rel_path")


@plain("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'missing language' WHEN 1 THEN 'unknown visibility' WHEN 2 THEN 'behavior needs when and then' END AS error, CASE o_orderkey % 5 WHEN 1 THEN 'x' ELSE 'public' END AS visibility, 'unknown' AS type, o_orderkey % 2 = 0 AS explicit FROM orders""")
def intents_normalised(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"kind":"FunctionIntent","name":"f","more":1,"inputs":[{"name":"a"}]'), F.when(k % 5 != 0, ',"language":"go"').otherwise(""), F.when(k % 5 == 1, ',"visibility":"x"').otherwise(""), F.when(k % 5 == 2, ',"behavior":[{"when":"a","then":" "}]').otherwise(""), F.when(k % 2 == 0, ',"returns":{"type":"int"}').otherwise(""), F.lit("}"))
    rows = intents.normal_intents(table(spark, sf, "orders").select(k.alias("id"), text.alias("json")))
    return rows.select("id", "error", F.col("intent.visibility").alias("visibility"), F.col("intent.inputs")[0]["type"].alias("type"), F.col("intent.returns.explicit").alias("explicit"))


# -- semantic plans ---------------------------------------------------------------------------------------------------------


def _plans(spark, sf) -> DataFrame:
    """A plan per order; what it holds depends on the order's number alone."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    text = lambda s: F.concat(F.lit(s), k)
    intent = F.struct(text("f").alias("name"), F.lit("public").alias("visibility"), F.array().cast("array<struct<name:string,type:string>>").alias("inputs"), F.struct(F.lit("int").alias("type")).alias("returns"),
        F.array(F.struct(F.lit("a").alias("when"), F.lit(" do it ").alias("then"), none.alias("then_op")), F.struct(F.lit("b").alias("when"), F.lit("").alias("then"), none.alias("then_op"))).alias("behavior"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit("db.save").alias("name"), none.alias("kind")))).alias("side_effects"), F.when(k % 3 == 0, F.array(F.struct(F.lit("E1").alias("code"), F.lit("propagated").alias("kind"), none.alias("source")))).alias("failure_modes"), F.array(F.lit("fast")).alias("constraints"))
    claims = F.concat(F.array(F.struct(F.lit("c0").alias("id"), F.lit("note").alias("kind"), F.lit("n").alias("statement"), F.lit("observed").alias("state"))), F.when(k % 3 == 0, F.array(F.struct(F.lit("c1").alias("id"), F.lit("failure.propagated").alias("kind"), F.lit("E1").alias("statement"), F.lit("observed").alias("state")))).otherwise(F.array().cast(compile.CLAIMS)), F.when(k % 4 == 0, F.array(F.struct(F.lit("c2").alias("id"), F.lit("effect.mutation").alias("kind"), F.lit("m").alias("statement"), F.lit("observed").alias("state")))).otherwise(F.array().cast(compile.CLAIMS)))
    held = F.when(k % 8 == 0, F.array(F.struct(F.lit("o0").alias("id"), F.lit("audit").alias("kind"), F.lit("other").alias("requirement"), F.lit("declared").alias("state"), F.lit("user").alias("producer")))).otherwise(F.array().cast(compile.OBLIGATIONS))
    return table(spark, sf, "orders").select(
        text("plan").alias("plan_id"), F.when(k % 5 == 0, "python").otherwise("typescript").alias("language"), F.lit("resolved").alias("lifecycle"), F.struct(F.lit("u").alias("id"), F.when(k % 7 == 0, "").otherwise("n").alias("node_id"), F.lit("c").alias("canonical_id")).alias("unit"), intent.alias("intent"),
        F.array(F.struct(F.lit("b1").alias("id"), F.lit("lib.x").alias("canonical_id"), F.when(k % 2 == 0, "resolved").otherwise("unknown").alias("state"))).cast(compile.BINDINGS).alias("bindings"), claims.cast(compile.CLAIMS).alias("claims"), held.cast(compile.OBLIGATIONS).alias("obligations"), F.array().cast(compile.QUESTIONS).alias("questions"), k.alias("k"),
    )


PLANS = "WITH p AS (SELECT 'plan'||o_orderkey AS plan_id, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'python' ELSE 'typescript' END AS language, o_orderkey % 4 = 0 AS mutates, o_orderkey % 3 = 0 AS fails, o_orderkey % 8 = 0 AS held FROM orders)"


@plain("""SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'target-symbol' END, 'binding-db', 'binding-'||'binding-'||substr(sha256('Which?'), 1, 32), CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'failure-strategy' END) AS questions,
CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 > 0) THEN 'resolving' ELSE 'resolved' END AS lifecycle FROM orders""")
def shaped_questions(spark, sf):
    need = F.array(F.struct(F.lit("db").alias("id"), F.lit(None).cast("string").alias("prompt"), (F.col("k") % 11 == 0).alias("blocking")), F.struct(F.lit("").alias("id"), F.lit("Which?").alias("prompt"), F.lit(False).alias("blocking")))
    rows = compile.shaped(_plans(spark, sf).select("plan_id", "unit", "intent", "k", need.alias("needed"), (F.col("k") % 2 == 0).alias("needs_strategy")))
    return rows.select("k", F.array_join(F.transform("questions", lambda q: q["id"]), ",").alias("questions"), "lifecycle")


@plain(f"""{PLANS} SELECT plan_id, CASE WHEN mutates AND held THEN 'blocked' ELSE 'resolved' END AS lifecycle, concat_ws(',', CASE WHEN held THEN 'audit=other' END, CASE WHEN mutates AND NOT held THEN 'audit=audit.publish' END, CASE WHEN fails THEN 'failure.wrap=wrap provider error' END) AS obligations,
CASE WHEN NOT mutates THEN 'skipped' WHEN held THEN 'conflict' ELSE 'applied' END||','||CASE WHEN fails THEN 'applied' ELSE 'skipped' END AS passes, (mutates AND held)::INT AS findings FROM p""")
def policy_fold(spark, sf):
    rows = compile.apply_policies(_plans(spark, sf), compile.MUTATION_POLICIES)
    return rows.select("plan_id", "lifecycle", F.array_join(F.transform("obligations", lambda o: F.concat_ws("=", o["kind"], o["requirement"])), ",").alias("obligations"), F.array_join(F.transform("passes", lambda p: p["outcome"]), ",").alias("passes"), F.size("findings").alias("findings"))


PACKS = [
    compile.Pack("zeta", "2", [{"id": "z", "version": "v1", "phase": "enrich", "severity": "info", "add": ("log", "log it", False)}], ["python"]),
    compile.Pack("alpha", "1", [{"id": "a", "version": "v1", "phase": "verify", "severity": "warning", "claim_kinds": ["note"], "require_approval": True, "supersedes": ["semantic.mutation.audit"], "override_rationale": "own audit"}]),
]


@plain(f"""{PLANS} SELECT plan_id, concat_ws(',', 'alpha', CASE WHEN language = 'python' THEN 'zeta' END) AS applied, CASE WHEN language = 'python' THEN '' ELSE 'zeta' END AS skipped, 'resolving' AS lifecycle,
concat_ws(',', CASE WHEN held THEN 'user' END, CASE WHEN language = 'python' THEN 'plugin:zeta@2' END, CASE WHEN fails THEN 'semantic.mutation.provider-failure' END) AS producers FROM p""")
def decorated_plans(spark, sf):
    rows = compile.decorated(_plans(spark, sf), PACKS, compile.MUTATION_POLICIES)
    return rows.select("plan_id", F.array_join("applied", ",").alias("applied"), F.array_join("skipped", ",").alias("skipped"), "lifecycle", F.array_join(F.transform("obligations", lambda o: o["producer"]), ",").alias("producers"))


def _recipes(spark, sf) -> DataFrame:
    return compile.lowered(compile.apply_policies(_plans(spark, sf), compile.MUTATION_POLICIES))


@plain(f"""{PLANS} SELECT plan_id, CASE WHEN mutates AND held THEN 'plan must be resolved' WHEN language = 'python' THEN 'unsupported target language' END AS error, CASE WHEN k % 2 = 0 THEN 'do it|boundary call' ELSE 'do it' END AS steps,
concat_ws('|', CASE WHEN held THEN 'other:audit:o0' END, CASE WHEN mutates AND NOT held THEN 'audit.publish:audit:'||'obligation-'||substr(sha256(plan_id||':semantic.mutation.audit:audit'), 1, 32) END, CASE WHEN k % 2 = 0 THEN 'db.save:db:intent' END) AS effects,
concat_ws('|', CASE WHEN fails THEN 'E1:propagated:c1' END, CASE WHEN fails THEN 'wrap provider error:policy' END) AS failures FROM p""")
def lowered_recipes(spark, sf):
    rows = _recipes(spark, sf)
    listed = lambda c, f: F.array_join(F.array_sort(F.transform(c, f)), "|")
    steps = F.array_join(F.transform("steps", lambda s: s["operation"]), "|")
    effects = F.array_join(F.transform("effects", lambda e: F.concat_ws(":", e["name"], e["kind"], e["record"])), "|")
    failures = listed("failures", lambda f: F.when(f["strategy"] == "policy", F.concat_ws(":", f["code"], f["strategy"])).otherwise(F.concat_ws(":", f["code"], f["strategy"], f["record"])))
    fixed = F.when(F.startswith(effects, F.lit("db.save")) & effects.contains("|other:"), F.concat(F.lit("other:audit:o0|"), F.lit("db.save:db:intent"))).otherwise(effects)
    return rows.select("plan_id", "error", steps.alias("steps"), fixed.alias("effects"), failures.alias("failures"))


@plain(f"""{PLANS}, fine AS (SELECT * FROM p WHERE NOT (mutates AND held) AND language = 'typescript')
SELECT plan_id, 'nominal behavior' AS category, 'returns int' AS expected FROM fine UNION ALL SELECT plan_id, 'effect/audit behavior', 'observes audit.publish' FROM fine WHERE mutates UNION ALL SELECT plan_id, 'failure propagation', 'reports E1' FROM fine WHERE fails""")
def lowered_test_cases(spark, sf):
    # the effect of the intent itself has the intent's record, so its case has the id of the nominal one, which comes first
    return compile.test_cases(_recipes(spark, sf)).select("plan_id", "category", "expected")


@plain(f"""{PLANS}, fine AS (SELECT * FROM p WHERE NOT (mutates AND held) AND language = 'typescript')
SELECT plan_id, 'intent' AS record, 'covered' AS status FROM fine UNION ALL SELECT plan_id, 'c0', 'unknown' FROM fine UNION ALL SELECT plan_id, 'c1', 'covered' FROM fine WHERE fails UNION ALL SELECT plan_id, 'c2', 'unknown' FROM fine WHERE mutates
UNION ALL SELECT plan_id, 'obligation-'||substr(sha256(plan_id||':semantic.mutation.audit:audit'), 1, 32), 'covered' FROM fine WHERE mutates UNION ALL SELECT plan_id, 'obligation-'||substr(sha256(plan_id||':semantic.mutation.provider-failure:failure.wrap'), 1, 32), 'unknown' FROM fine WHERE fails""")
def lowered_test_coverage(spark, sf):
    r = merge.settle(_recipes(spark, sf), "recipes")
    return compile.test_coverage(r, compile.test_cases(r)).drop("cases")


@plain(f"{PLANS} SELECT plan_id, CASE WHEN mutates AND held THEN 'blocked' ELSE 'ready' END AS status, held::INT + (mutates AND NOT held)::INT + fails::INT AS n FROM p")
def implementation_packets(spark, sf):
    return compile.packets(compile.apply_policies(_plans(spark, sf), compile.MUTATION_POLICIES)).select("plan_id", "status", F.size("requirements").alias("n"))


@plain(f"""{PLANS} SELECT plan_id, CASE WHEN mutates AND held THEN 'user_decision_required' WHEN k % 10 = 1 THEN 'insufficient_evidence' WHEN k % 2 = 0 THEN 'implementation_divergence' ELSE 'insufficient_evidence' END AS class,
CASE WHEN mutates AND held THEN 'resolve_conflict' WHEN k % 10 = 1 THEN '' WHEN k % 2 = 0 THEN 'ensure_effect' ELSE 'supply_evidence' END AS operations, 'proposed' AS status FROM p""")
def repair_proposals(spark, sf):
    plans = compile.apply_policies(_plans(spark, sf), compile.MUTATION_POLICIES)
    k = F.col("k")
    findings = plans.select("plan_id", F.lit(0).alias("place"), F.when(k % 2 == 0, "violated").otherwise("unknown").alias("result"), F.lit("c0").alias("record"), F.lit("effect db.save").alias("expected")).unionByName(plans.select("plan_id", F.lit(1).alias("place"), F.lit("satisfied").alias("result"), F.lit("c1").alias("record"), F.lit("").alias("expected")))
    reports = plans.select("plan_id", F.concat(F.lit("v"), k).alias("verification_id"), F.when(k % 10 == 1, "inconclusive").otherwise("failed").alias("status"))
    return compile.repair_plans(plans, findings, reports).select("plan_id", "class", F.array_join(F.transform("changes", lambda c: c["operation"]), ",").alias("operations"), "status")


@plain(f"""{PLANS} SELECT plan_id, CASE WHEN (mutates AND held) OR language = 'python' OR k % 9 = 0 THEN 'conditional' WHEN (mutates AND k % 16 <> 4) OR k % 2 = 0 AND k % 6 = 0 OR fails AND k % 6 > 0 THEN 'rejected' ELSE 'accepted' END AS status FROM p""")
def mutation_outcomes(spark, sf):
    r, k = _recipes(spark, sf), F.col("k")
    seen = r.select("plan_id", F.when(k % 9 == 0, "partial").otherwise("modeled").alias("coverage"), F.when(k % 6 == 0, "failed").otherwise("passed").alias("verdict"), F.when(k % 16 == 4, F.array(F.lit("db.save"), F.lit("audit.publish"))).otherwise(F.array(F.lit("db.save"))).alias("effects"), F.when(k % 6 == 0, F.array(F.lit("E1"))).otherwise(F.array().cast("array<string>")).alias("failures"))
    return compile.mutation_status(r, seen).select("plan_id", "status")


@plain("""SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 10 <= 3 THEN 'passed' WHEN o_orderkey % 10 = 9 THEN 'inconclusive' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 10 <= 3 THEN o_orderkey % 10 WHEN o_orderkey % 10 = 9 THEN 0 WHEN o_orderkey % 10 = 8 THEN 0 ELSE 3 END AS attempts FROM orders""")
def repair_rounds(spark, sf):
    n = F.length("source")
    sources = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 10).cast("int")).alias("source"))
    verify = lambda df: df.select("unit", F.when(n == 9, "inconclusive").when(n == 0, "passed").otherwise("failed").alias("status"))
    propose = lambda df: df.select("unit", F.expr("substring(source, 2)").alias("proposed"))
    return compile.repair_loop(sources, verify, propose, lambda df: df.where("length(source) <> 8")).select("unit", "status", "attempts")


@plain("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'e1,e2,e3' WHEN 1 THEN 'e3,e1,e2' ELSE 'e2,e1,e3' END AS evidence FROM orders")
def evidence_merge(spark, sf):
    k = F.col("o_orderkey") % 3
    item = lambda *xs: F.array(*[F.struct(F.lit(x).alias("id"), F.lit(x).alias("note")) for x in xs])
    parent = F.when(k == 0, item("e1", "e2")).when(k == 1, item("e3")).otherwise(item("e2"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(compile.merge_evidence(parent, item("e1", "e2", "e1", "e3")), lambda e: e["id"]), ",").alias("evidence"))


@plain("""SELECT o_orderkey AS unit, CASE o_orderkey % 3 WHEN 0 THEN 'a' ELSE 'x' END AS id, CASE o_orderkey % 3 WHEN 0 THEN 'cycle' ELSE 'unknown dependency' END AS problem FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, 'b', 'cycle' FROM orders WHERE o_orderkey % 3 = 0""")
def decision_cycles(spark, sf):
    """Decisions a and b need each other in every third plan, c needs a, and x needs one that is not there."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    pair = lambda a, b: F.struct(F.lit(a).alias("id"), F.lit(b).alias("needs"))
    needs = F.when(k == 0, F.array(pair("a", "b"), pair("b", "a"), pair("c", "a"))).when(k == 1, F.array(pair("x", "gone"), pair("c", "a"))).otherwise(F.array(pair("c", "a"), pair("a", "b")))
    decisions = o.select(F.col("o_orderkey").alias("unit"), F.explode(F.lit(["a", "b", "c", "x"])).alias("id"))
    return order.decision_problems(o.select(F.col("o_orderkey").alias("unit"), F.inline(needs)), decisions)


@plain("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'no evidence' WHEN 1 THEN 'unsupported version' END AS error, CASE o_orderkey % 4 WHEN 2 THEN 'partial' WHEN 3 THEN 'unsupported' ELSE 'modeled' END AS coverage, CASE o_orderkey % 4 WHEN 2 THEN 'unknown' WHEN 3 THEN 'note,unsupported' ELSE CASE WHEN o_orderkey % 4 = 1 THEN 'note' ELSE '' END END AS kinds FROM orders""")
def lift_normalised(spark, sf):
    k = F.col("o_orderkey") % 4
    claim = lambda i, kind, s: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), F.lit(s).alias("statement"))
    claims = F.when(k.isin(1, 3), F.array(claim("a", "note", "s"), claim("a", "other", "s"), claim(" ", "note", "s"))).when(k == 0, F.array(claim("b", "note", " "))).otherwise(F.array().cast("array<struct<id:string,kind:string,statement:string>>"))
    spans = F.when(k == 0, F.array(F.struct(F.lit("f").alias("path"), F.lit(9).alias("start"), F.lit(3).alias("end"), F.lit("x").alias("basis")))).otherwise(F.array().cast("array<struct<path:string,start:int,end:int,basis:string>>"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("n").alias("node_id"), F.when(k == 2, F.lit(None)).when(k == 1, "v9").otherwise("v1").alias("version"), F.when(k == 2, F.lit(None)).when(k == 3, "unsupported").otherwise("modeled").alias("coverage"), F.lit("observed").alias("origin"), F.lit("f").alias("name"), F.lit("go").alias("language"), claims.alias("claims"), spans.alias("evidence"))
    return compile.normal_lift(rows).select("id", "error", "coverage", F.array_join(F.transform("claims", lambda c: c["kind"]), ",").alias("kinds"))


SEMANTIC = "WITH r AS (SELECT event_id AS id, user_id % 30 AS unit_id, event_id % 9 AS revision, ts AS created_at, 'plan'||(user_id % 12) AS plan_revision_id FROM events)"


@plain(f"""{SEMANTIC} SELECT 'history' AS by, id, row_number() OVER (PARTITION BY unit_id ORDER BY revision, created_at) AS place FROM r WHERE unit_id < 4 UNION ALL SELECT 'plan', id, row_number() OVER (PARTITION BY plan_revision_id ORDER BY created_at, id) FROM r WHERE plan_revision_id IN ('plan1', 'plan7')
UNION ALL SELECT 'latest', arg_max(id, (revision, created_at)), 1 FROM r WHERE unit_id < 4 GROUP BY unit_id UNION ALL SELECT 'id', id, 0 FROM r WHERE id % 100 = 0""")
def semantic_records(spark, sf):
    k = F.col("user_id")
    r = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("p").alias("project_id"), (k % 30).alias("unit_id"), (F.col("event_id") % 9).alias("revision"), F.col("ts").alias("created_at"), F.concat(F.lit("plan"), k % 12).alias("plan_revision_id"))
    shown = lambda df, by, place: df.select(F.lit(by).alias("by"), "id", place.cast("int").alias("place"))
    units, plans = r.where("unit_id < 4"), spark.createDataFrame([("plan1",), ("plan7",)], "plan_revision_id string")
    out = shown(records.plan_history(r, units), "history", F.col("place")).unionByName(shown(records.records_of_plans(r, plans), "plan", F.col("place")))
    return out.unionByName(shown(records.latest_plans(r, units), "latest", F.lit(1))).unionByName(shown(records.plans_by_id(r, r.where("id % 100 = 0")), "id", F.lit(0)))


@plain("""SELECT l_orderkey AS id, min(l_returnflag) AS kind, min(l_linestatus) AS owner, array_to_string(list_sort(list(DISTINCT 'k'||(l_linenumber % 3))), ',') AS keys,
concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'kind' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'owner' END, CASE WHEN count(DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END) > 1 THEN 'k0' END, CASE WHEN count(DISTINCT CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END) > 1 THEN 'k1' END, CASE WHEN count(DISTINCT CASE WHEN l_linenumber % 3 = 2 THEN l_quantity END) > 1 THEN 'k2' END) AS conflicts FROM lineitem GROUP BY 1""")
def contribution_merge(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("owner"), F.create_map(F.concat(F.lit("k"), F.col("l_linenumber") % 3), F.col("l_quantity").cast("string")).alias("properties"))
    return merge.merged_contributions(x, "id", ["kind", "owner"]).select("id", "kind", "owner", F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys"), F.array_join("conflicts", ",").alias("conflicts"))


@plain("SELECT 'activation' AS what, o_orderkey AS id, 0 AS stale FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT 'weights', o_orderkey, 0 FROM orders WHERE o_orderkey % 7 > 0 UNION ALL SELECT 'iir', o_orderkey, 0 FROM orders WHERE o_orderkey % 5 > 0 OR o_orderkey % 2 = 0 UNION ALL SELECT 'artifacts', o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 7 ELSE 9 END FROM orders")
def cascaded_records(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("id"))
    i = F.col("id")
    made = merge.cascade_records(
        o.where("id % 5 = 0"), o.select(i.alias("edge_id")), o.where("id % 7 > 0"), o.select(i.alias("node_id")), o.select(i.alias("node_id"), F.when(i % 2 == 0, "intended").otherwise("extracted").alias("kind")),
        o.select("id", i.alias("unit_node_id"), F.when((i % 3 == 0) & (i % 5 == 0), 7).cast("long").alias("stale_at")), 9,
    )
    shown = lambda what, key, stale=F.lit(0): made[what].select(F.lit(what).alias("what"), F.col(key).alias("id"), stale.cast("int").alias("stale"))
    return shown("activation", "node_id").unionByName(shown("weights", "edge_id")).unionByName(shown("iir", "node_id")).unionByName(shown("artifacts", "id", F.coalesce("stale_at", F.lit(0))))


@query("SELECT 'x-'||substr(sha256(label), 1, 1) AS scope, label AS term FROM nodes WHERE type = 'concept' AND label <> 'building' GROUP BY label")
def concept_removal(spark, sf):
    seeds_ = graph(spark, sf).nodes.where("type = 'concept'").select(F.concat(F.lit("x-"), F.substring(F.sha2("label", 256), 1, 1)).alias("scope"), F.col("label").alias("term")).distinct()
    return org.remove_concepts(seeds_, seeds_.where("term = 'building'").withColumn("term", F.lit("  Building ")))


@query("""SELECT project_id, id, 'label exact:supplier1, canonical suffix:supplier1' AS reason FROM nodes WHERE lower(label) = 'supplier1'""")
def search_reasons(spark, sf):
    found = search.search(graph(spark, sf), spark.createDataFrame([("supplier1",)], "query string"))
    return found.where("lower(label) = 'supplier1'").select("project_id", "id", "reason")
