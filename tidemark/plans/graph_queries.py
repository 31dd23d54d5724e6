"""Retrieval, conversations, history, similarity, graphs, healing, replicas and generic relational work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import edit_distance, jaccard, space_words
from tidemark.operators import graphs, retrieval, store
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, MEMORIES_SQL, events, load, memories, messages

MEM, EV = f"WITH {MEMORIES_SQL} ", f"WITH {EVENTS_SQL} "
QUERY = "the nation and thing"
_WORDS = ("the", "nation", "and", "thing")
_BM25 = f"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents), co AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tk),
q AS (SELECT unnest({list(_WORDS)}) AS token), tf AS (SELECT doc_id, len(t) AS dl, token, len([x for x in t if x = token]) AS tf FROM tk, q WHERE list_contains(t, token)),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), rw AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS raw FROM tf JOIN df USING (token), co GROUP BY doc_id),
bm AS (SELECT doc_id, raw / (SELECT max(raw) FROM rw) AS score FROM rw)"""


@query(f"WITH {_BM25} SELECT doc_id AS entry_id, round(score, 6) AS score FROM bm WHERE score > 0.01")
def r04_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(memories(spark, sf), QUERY).select("entry_id", F.round("score", 6).alias("score"))


RECALL_SQL = f"""WITH {_BM25}, b AS (SELECT doc_id, 'bm25' AS signal, 0.9 * score AS s FROM bm WHERE score > 0.1 ORDER BY round(score, 9) DESC, doc_id LIMIT 30),
kr AS (SELECT doc_id, token, tf, row_number() OVER (PARTITION BY token ORDER BY tf DESC, doc_id) - 1 AS i, least(20, count(*) OVER (PARTITION BY token)) AS n FROM tf),
k AS (SELECT doc_id, 'keyword' AS signal, max(0.8 - 0.3 * i / n + 0.2) AS s FROM kr WHERE i < 20 GROUP BY doc_id), a AS (SELECT * FROM b UNION ALL SELECT * FROM k),
f AS (SELECT doc_id, sum(w * s) / sum(w) * CASE WHEN count(*) >= 3 THEN 1.2 WHEN count(*) = 2 THEN 1.1 ELSE 1 END AS score, count(*) AS n_signals FROM (SELECT *, CASE signal WHEN 'bm25' THEN 0.2 ELSE 0.25 END AS w FROM a) GROUP BY doc_id)
SELECT doc_id AS entry_id, round(least(1.0, score), 6) AS score, n_signals FROM f ORDER BY score DESC, doc_id LIMIT 20"""


@query(RECALL_SQL)
def r20_recall(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.recall(memories(spark, sf), QUERY)


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS cosine FROM embeddings, q)
SELECT vec_id, cosine FROM c ORDER BY cosine DESC, vec_id LIMIT 20""")
def j18_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings")
    return retrieval.vector_top(v, v.where("vec_id = 0"), 20)


@query(f"""WITH r AS ({RECALL_SQL}), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id) AS place FROM r), c AS (SELECT *, score >= 0.7 AND place <= 3 AS core FROM p)
SELECT entry_id, score, CASE WHEN core THEN 'core' WHEN score >= 0.35 AND row_number() OVER (PARTITION BY core ORDER BY score DESC, entry_id) <= 5 THEN 'context' ELSE 'archive' END AS stage FROM c""")
def r27_staging(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.stage(retrieval.recall(memories(spark, sf), QUERY)).select("entry_id", "score", "stage")


@query("SELECT conv_id AS session_id, count(*) AS n_parts, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def j10_nest_parts(spark: SparkSession, sf: str) -> DataFrame:
    nested = messages(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("parts"))
    return nested.select("session_id", F.size("parts").cast("long").alias("n_parts"), F.array_join(F.transform("parts", lambda p: p["role"]), ">").alias("roles"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j05_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    segment = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return load(spark, sf, "orders").join(segment, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j11_missing_reference(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").join(load(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT d.doc_id AS entry_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j08_left_default(spark: SparkSession, sf: str) -> DataFrame:
    lab = load(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), "quality")
    return memories(spark, sf).select("entry_id").join(lab, "entry_id", "left").select("entry_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations), t AS (SELECT conv_id, rn FROM m WHERE turn = 2)
SELECT m.conv_id AS session_id, m.turn, m.role FROM m JOIN t ON m.conv_id = t.conv_id AND abs(m.rn - t.rn) <= 1""")
def w02_around_message(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn", "role")
    near = F.max(F.col("turn") == 2).over(w.rowsBetween(-1, 1))
    return messages(spark, sf).withColumn("near", near).where("near").select("session_id", "turn", "role")


@query(EV + 'SELECT event_id, lag(event_id) OVER (PARTITION BY memory_id ORDER BY "at", event_id) AS from_event FROM ev')
def w03_previous_event(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("memory_id").orderBy("at", "event_id")
    return events(spark, sf).select("event_id", F.lag("event_id").over(w).alias("from_event"))


@query("SELECT conv_id AS session_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def w04_last_message(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).groupBy("session_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@query("""SELECT conv_id AS session_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n > 3 AND rn <= n - 3""")
def w05_uncondensed(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("session_id")
    return messages(spark, sf).withColumn("rn", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w)).where("n > 3 AND rn <= n - 3").select("session_id", "turn")


@query(EV + 'SELECT event_id, lead("at") OVER (PARTITION BY memory_id, kind ORDER BY "at", event_id) AS ends_at FROM ev')
def w07_state_chain(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.lead("at").over(Window.partitionBy("memory_id", "kind").orderBy("at", "event_id")).alias("ends_at"))


@query(EV + 'SELECT event_id, memory_id, row_number() OVER (PARTITION BY memory_id, kind ORDER BY "at" DESC, event_id DESC) = 1 AS is_active FROM ev')
def w08_state_exclusivity(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("memory_id", "kind").orderBy(F.desc("at"), F.desc("event_id"))
    return events(spark, sf).select("event_id", "memory_id", (F.row_number().over(w) == 1).alias("is_active"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def w11_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return store.per_key(load(spark, sf, "documents").select("doc_id", "lang"), ["lang"], 10, "doc_id").drop("rn")


@query("""WITH t AS (SELECT conv_id, turn, list_distinct([x for x in string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+') if x <> '']) AS w FROM conversations)
SELECT a.conv_id AS session_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def x03_token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select("session_id", "turn", space_words(F.col("content")).alias("w"))
    later = m.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return m.join(later, ["session_id", "turn"]).select("session_id", "turn", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("""WITH p AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part)
SELECT p_partkey, round(levenshtein(left(p_name, 500), left(nxt, 500)) / greatest(length(p_name), length(nxt)), 6) AS distance FROM p WHERE nxt IS NOT NULL""")
def x04_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    nxt = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    pairs = load(spark, sf, "part").select("p_partkey", "p_name", nxt.alias("nxt")).where("nxt IS NOT NULL")
    return pairs.select("p_partkey", F.round(edit_distance(F.col("p_name"), F.col("nxt")), 6).alias("distance"))


@query("SELECT page_id, element_at(string_split(url, '/'), 1)[1] AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, string_split(url, '/')[-1] AS filename FROM pages".replace("element_at(string_split(url, '/'), 1)[1]", "string_split(url, '/')[1]"))
def x16_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("url", "/")
    return load(spark, sf, "pages").select("page_id", F.element_at(parts, 1).alias("scheme"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), F.element_at(parts, -1).alias("filename"))


def _cooc(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.cooccurrence(load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


_COOC_SQL = "l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), co AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS weight FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)"


@query(f"WITH {_COOC_SQL} SELECT a, b, weight FROM co")
def g02_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return _cooc(spark, sf)


@query(f"WITH RECURSIVE {_COOC_SQL}, w AS (SELECT 1 AS n, 1.0::DOUBLE AS w UNION ALL SELECT n + 1, w + 1.0 / (1 + 0.1 * w) FROM w WHERE n < (SELECT max(weight) FROM co)) SELECT a, b, weight AS n, round(w, 6) AS weight FROM co JOIN w ON w.n = weight")
def a06_diminishing_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.diminishing(_cooc(spark, sf))


@query(f"WITH {_COOC_SQL}, d AS (SELECT a AS node, weight FROM co UNION ALL SELECT b, weight FROM co) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM d GROUP BY node")
def a08_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.degrees(_cooc(spark, sf))


@query(f"""WITH {_COOC_SQL}, e AS (SELECT a, b FROM co WHERE weight >= 3 UNION ALL SELECT b, a FROM co WHERE weight >= 3), one AS (SELECT DISTINCT b AS node FROM e WHERE a = 1), two AS (SELECT DISTINCT e.b AS node FROM e JOIN one ON e.a = one.node)
SELECT node, min(depth) AS depth FROM (SELECT 1 AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node""")
def g08_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    edges = _cooc(spark, sf).where("weight >= 3")
    return graphs.neighbours(edges, spark.range(1, 2).select(F.col("id").alias("node")), 2)


@query(MEM + "SELECT entry_id, CASE WHEN created_at - touched_at < 3600 THEN 'info' ELSE 'warning' END AS severity FROM mem WHERE touched_at < created_at")
def h06_temporal_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("touched_at < created_at").select("entry_id", F.when(F.col("created_at") - F.col("touched_at") < 3600, "info").otherwise("warning").alias("severity"))


@query(EV + 'SELECT memory_id, arg_max(k, ("at", event_id % 3, event_id)) AS k, arg_max(event_id % 3, ("at", event_id % 3, event_id)) AS node FROM ev GROUP BY memory_id'.replace('arg_max(k, ("at", event_id % 3, event_id))', 'arg_max(k, row("at", event_id % 3, event_id))').replace('arg_max(event_id % 3, ("at", event_id % 3, event_id))', 'arg_max(event_id % 3, row("at", event_id % 3, event_id))'))
def y05_last_writer_wins(spark: SparkSession, sf: str) -> DataFrame:
    version = F.struct("at", (F.col("event_id") % 3).alias("node"), "event_id", "k")
    return events(spark, sf).groupBy("memory_id").agg(F.max(version).alias("v")).select("memory_id", "v.k", "v.node")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def rel_pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def rel_regional_revenue(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation").join(load(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))
