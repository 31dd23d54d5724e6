"""Signals of search, conversations, replicas and small text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import latin_words
from tidemark.operators import history, retrieval, store
from tidemark.plans.graph_queries import _BM25, QUERY
from tidemark.plans.memory_queries import _ENTITY_SQL, _entities
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, MEMORIES_SQL, events, load, memories, messages

MEM, EV = f"WITH {MEMORIES_SQL}", f"WITH {EVENTS_SQL}"

# ---- signals ----

_KEYWORD_SQL = f"""WITH {_BM25}, kr AS (SELECT doc_id, token, row_number() OVER (PARTITION BY token ORDER BY tf DESC, doc_id) - 1 AS i, least(20, count(*) OVER (PARTITION BY token)) AS n FROM tf),
k AS (SELECT doc_id AS entry_id, token, 0.8 - 0.3 * i / n + 0.2 AS score FROM kr WHERE i < 20)"""


@query(f"{_KEYWORD_SQL} SELECT entry_id, round(max(score), 6) AS score, count(*) AS n_words FROM k GROUP BY entry_id")
def r11_keyword_signal(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.keyword_signal(memories(spark, sf), ["the", "nation", "and", "thing"])
    return hits.groupBy("entry_id").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n_words"))


_ENTITY_SIGNAL_SQL = f"""{_ENTITY_SQL}, to_ AS (SELECT label FROM en GROUP BY label ORDER BY count(*) DESC, label LIMIT 3),
es AS (SELECT entry_id, label, row_number() OVER (PARTITION BY label ORDER BY decay DESC, entry_id) - 1 AS i, least(20, count(*) OVER (PARTITION BY label)) AS n FROM en JOIN to_ USING (label) JOIN mem USING (entry_id))"""


def _entity_signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entities(spark, sf).select("entry_id", "label")
    asked = store.top(rows.groupBy("label").agg(F.count("*").alias("n")), 3, F.desc("n"), "label").select("label")
    hits = rows.join(F.broadcast(asked), "label").join(memories(spark, sf).select("entry_id", "decay"), "entry_id")
    return retrieval.place_signal(hits, "entity", "label", 0.9, 0.4, 20, F.desc("decay"), "entry_id")


@query(f"{_ENTITY_SIGNAL_SQL} SELECT entry_id, round(max(0.9 - 0.4 * i / n), 6) AS score FROM es WHERE i < 20 GROUP BY entry_id")
def r13_entity_signal(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty strongest memories of each of three entities asked for (here the most frequent)."""
    return _entity_signal(spark, sf).groupBy("entry_id").agg(F.round(F.max("score"), 6).alias("score"))


_SCOPE_SQL = f"""{MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY decay DESC, touched_at DESC, entry_id) AS rn FROM mem WHERE scope_id = 'src1')
SELECT entry_id FROM r WHERE rn <= 100 ORDER BY decay DESC, touched_at DESC, entry_id LIMIT 100"""


def _scope_signal(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_scope(memories(spark, sf), "src1", 100).select("entry_id", F.lit("scope_boost").alias("signal"), F.lit(0.3).alias("score"))


@query(f"SELECT entry_id, CAST(0.3 AS DOUBLE) AS score FROM ({_SCOPE_SQL})")
def r15_scope_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the scope become candidates; others stay."""
    return _scope_signal(spark, sf).select("entry_id", "score")


@query(f"""WITH kw AS (SELECT entry_id, 'keyword' AS signal, max(score) AS s FROM ({_KEYWORD_SQL} SELECT * FROM k) GROUP BY entry_id),
bs AS (WITH {_BM25} SELECT doc_id AS entry_id, 'bm25' AS signal, 0.9 * score AS s FROM bm WHERE score > 0.1 ORDER BY round(score, 9) DESC, doc_id LIMIT 30),
ei AS (SELECT entry_id, 'entity' AS signal, max(score) AS s FROM ({_ENTITY_SIGNAL_SQL} SELECT entry_id, 0.9 - 0.4 * i / n AS score FROM es WHERE i < 20) GROUP BY entry_id),
sc AS (SELECT entry_id, 'scope_boost' AS signal, 0.3 AS s FROM ({_SCOPE_SQL})), a AS (SELECT * FROM kw UNION ALL SELECT * FROM bs UNION ALL SELECT * FROM ei UNION ALL SELECT * FROM sc),
f AS (SELECT entry_id, sum(w * s) / sum(w) * CASE WHEN count(*) >= 3 THEN 1.2 WHEN count(*) = 2 THEN 1.1 ELSE 1 END AS score, count(*) AS n_signals
 FROM (SELECT *, CASE signal WHEN 'bm25' THEN 0.2 WHEN 'keyword' THEN 0.25 WHEN 'entity' THEN 0.2 ELSE 0.05 END AS w FROM a) GROUP BY entry_id)
SELECT entry_id, round(least(1.0, score), 6) AS score, n_signals FROM f WHERE entry_id % 10 > 2""")
def r16_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Four signals, fused; R18: then only impressions stay (their ids end in three or more)."""
    rows = memories(spark, sf)
    words = ["the", "nation", "and", "thing"]
    found = retrieval.asked_postings(rows, words)
    signals = retrieval.bm25_signal(rows, QUERY, found=found).union(retrieval.keyword_signal(rows, words, found=found))
    signals = signals.union(_entity_signal(spark, sf)).union(_scope_signal(spark, sf))
    fused = retrieval.fuse(signals).select("entry_id", F.round("score", 6).alias("score"), "n_signals")
    return fused.join(rows.where("tier = 'impression'").select("entry_id"), "entry_id", "left_semi")


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT a, b, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-9), 6) AS cosine FROM p""")
def r23_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of neighbours, guarded against zero."""
    v = load(spark, sf, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    norm = lambda c: F.sqrt(retrieval.dot(F.col(c), F.col(c)))
    cosine = retrieval.dot(F.col("embedding"), F.col("after")) / (norm("embedding") * norm("after") + 1e-9)
    return v.join(after, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(cosine, 6).alias("cosine"))


# ---- conversations ----


@query("""SELECT conv_id AS session_id, turn, role, instr(lower(text), 'the') AS at, substr(text, greatest(1, instr(lower(text), 'the') - 5), 48) AS snippet FROM conversations
 WHERE contains(lower(text), 'the') AND role <> 'system'""")
def r26_conversation_search(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that hold a word, with the text around its first place."""
    at = F.instr(F.lower("content"), "the")
    hits = messages(spark, sf).where(F.contains(F.lower("content"), F.lit("the")) & (F.col("role") != "system"))
    return hits.select("session_id", "turn", "role", at.cast("long").alias("at"), F.substring("content", F.greatest(F.lit(1), at - 5), F.lit(48)).alias("snippet"))


_MENTION_SQL = "mt AS (SELECT conv_id AS session_id, turn, role, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS label FROM conversations)"


@query(f"WITH {_MENTION_SQL} SELECT label, session_id, turn, role, count(*) AS relevance FROM mt GROUP BY ALL")
def j03_entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities (words of eight letters or more) of every message, by how often it names them."""
    words = F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{8,})"), F.lit(1))
    return messages(spark, sf).select("session_id", "turn", "role", F.explode(words).alias("label")).groupBy("label", "session_id", "turn", "role").agg(F.count("*").alias("relevance"))


@query(f"WITH {_MENTION_SQL} SELECT label, session_id, max_by(turn, turn) AS last_turn, count(*) AS n FROM mt GROUP BY label, session_id")
def g14_message_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The bridge from sessions to entities: the last mention wins."""
    mentions = j03_entity_mentions(spark, sf)
    return mentions.groupBy("label", "session_id").agg(F.max("turn").alias("last_turn"), F.sum("relevance").cast("long").alias("n"))


@query("SELECT conv_id AS session_id, turn, role, length(text) >= 20 AND role IN ('user', 'assistant') AND NOT starts_with(text, '[') AS useful FROM conversations")
def f14_useful_messages(spark: SparkSession, sf: str) -> DataFrame:
    useful = (F.char_length("content") >= 20) & F.col("role").isin("user", "assistant") & ~F.startswith("content", F.lit("["))
    return messages(spark, sf).select("session_id", "turn", "role", useful.alias("useful"))


@query("SELECT user_id, event_id, json_extract_string(props, '$.k') AS k FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f15_batched_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a list of keys, and a field of their JSON."""
    wanted = load(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return load(spark, sf, "events").join(wanted, "user_id", "left_semi").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- history and replicas ----


@query(f"""{EV}, l AS (SELECT event_id, lag(event_id) OVER w AS parent, lead(event_id) OVER w AS child FROM ev WINDOW w AS (PARTITION BY memory_id ORDER BY "at", event_id)) SELECT event_id, parent, child FROM l""")
def j04_parents_and_children(spark: SparkSession, sf: str) -> DataFrame:
    edges = history.chain(events(spark, sf), "at", "event_id")
    up = edges.select(F.col("to_event").alias("event_id"), F.col("from_event").alias("parent"))
    down = edges.select(F.col("from_event").alias("event_id"), F.col("to_event").alias("child"))
    return events(spark, sf).select("event_id").join(up, "event_id", "left").join(down, "event_id", "left")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def j07_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose two ends are both in a set of nodes."""
    left = load(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    right = load(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return load(spark, sf, "lineitem").join(left, "l_suppkey", "left_semi").join(right, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query(f"{EV} SELECT event_id FROM ev WHERE kind = 'revised' AND memory_id IN (SELECT doc_id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM labels WHERE quality = 1)")
def j06_pending_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of the memories of a scope, whichever of several tables those are in."""
    scoped = load(spark, sf, "documents").where("source = 'src1'").select("doc_id").union(load(spark, sf, "labels").where("quality = 1").select("doc_id")).distinct()
    return events(spark, sf).where("kind = 'revised'").join(scoped, F.col("memory_id") == F.col("doc_id"), "left_semi").select("event_id")


#: Two replicas: odd and even events of a memory. Its clock counts the changes of each.
_CLOCK_SQL = f"""{EV}, cl AS (SELECT memory_id, kind, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b, max("at") AS "at" FROM ev GROUP BY memory_id, kind),
co AS (SELECT l.memory_id, l.a AS la, l.b AS lb, r.a AS ra, r.b AS rb, l."at" AS local_at, r."at" AS remote_at FROM cl l JOIN cl r USING (memory_id) WHERE l.kind = 'revised' AND r.kind = 'touched')"""
_ORDER_SQL = "CASE WHEN la = ra AND lb = rb THEN 'equal' WHEN la >= ra AND lb >= rb THEN 'a' WHEN ra >= la AND rb >= lb THEN 'b' ELSE 'concurrent' END"


def _clocks(spark: SparkSession, sf: str) -> DataFrame:
    counts = events(spark, sf).groupBy("memory_id", "kind").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"), F.max("at").alias("at"))
    clock = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("a", "b")).alias("clock")
    side = lambda kind, name: counts.where(F.col("kind") == kind).select("memory_id", clock.alias(name), F.col("at").alias(f"{name}_at"))
    return side("revised", "local").join(side("touched", "remote"), "memory_id")


@query(f"{_CLOCK_SQL} SELECT memory_id, {_ORDER_SQL} AS relation, greatest(la, ra) AS merged_a, greatest(lb, rb) + 1 AS merged_b FROM co")
def x23_vector_clock(spark: SparkSession, sf: str) -> DataFrame:
    """How two clocks stand to each other, and their maximum with node b moved on by one."""
    merged = history.merge_clocks(F.col("local"), F.col("remote"))
    return _clocks(spark, sf).select("memory_id", history.compare_clocks(F.col("local"), F.col("remote")).alias("relation"), merged["a"].alias("merged_a"), (merged["b"] + 1).alias("merged_b"))


@query(f"""{_CLOCK_SQL} SELECT memory_id, CASE WHEN {_ORDER_SQL} = 'concurrent' THEN 'conflict' WHEN remote_at <= local_at THEN 'skip' ELSE 'apply' END AS decision FROM co""")
def j19_apply_remote(spark: SparkSession, sf: str) -> DataFrame:
    """A remote change conflicts with a local one of a concurrent clock, is skipped when it is not newer, and else applies."""
    concurrent = history.compare_clocks(F.col("local"), F.col("remote")) == "concurrent"
    verdict = F.when(concurrent, "conflict").when(F.col("remote_at") <= F.col("local_at"), "skip").otherwise("apply")
    return _clocks(spark, sf).select("memory_id", verdict.alias("decision"))


@query(f"""{EV} SELECT event_id, memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY "at", event_id) AS tick FROM ev WHERE kind IN ('created', 'revised', 'healed')""")
def y01_change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a memory with the tick of its clock."""
    tick = F.row_number().over(Window.partitionBy("memory_id").orderBy("at", "event_id"))
    return events(spark, sf).where("kind IN ('created', 'revised', 'healed')").select("event_id", "memory_id", tick.alias("tick"))


# ---- small text rules ----


@query(r"""SELECT page_id, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'txt' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png'
 WHEN 'jpg' THEN 'image/jpeg' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'mp4' THEN 'video/mp4' ELSE '' END AS mime, left(sha1(page_id || ':' || url), 16) AS media_id FROM pages""")
def x16_mime_type(spark: SparkSession, sf: str) -> DataFrame:
    """The type an address has by its extension, and an id by whose it is and where."""
    known = {"html": "text/html", "txt": "text/plain", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "mp3": "audio/mpeg", "mp4": "video/mp4"}
    types = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    extension = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    media = F.left(F.sha1(F.concat_ws(":", F.col("page_id").cast("string"), "url")), F.lit(16))
    return load(spark, sf, "pages").select("page_id", F.coalesce(F.element_at(types, extension), F.lit("")).alias("mime"), media.alias("media_id"))


@query("""SELECT item_id, trim(regexp_replace(translate(lower(text), '.-,;!?''"', ''), ' +', ' ', 'g')) AS normal, len(regexp_extract_all(lower(text), '[a-z]+')) AS n_words FROM benchmark""")
def x07_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Lower case, without punctuation and doubled spaces."""
    bare = F.trim(F.regexp_replace(F.translate(F.lower("text"), ".-,;!?'\"", ""), " +", " "))
    return load(spark, sf, "benchmark").select("item_id", bare.alias("normal"), F.size(latin_words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(CAST(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP))::BIGINT AS seconds FROM orders")
def x19_iso_times(spark: SparkSession, sf: str) -> DataFrame:
    """Written as text and read back."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return load(spark, sf, "orders").select("o_orderkey", iso.alias("iso"), F.unix_timestamp(F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss")).alias("seconds"))
