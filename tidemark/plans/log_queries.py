"""Sessions, chains of memories, change logs of replicas, signals of search as sets, and streams that meet a row twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import graphs, retrieval, store
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, MEMORIES_SQL, events, load, memories, messages
from tidemark.streaming import replay

MEM, EV = f"WITH {MEMORIES_SQL}", f"WITH {EVENTS_SQL}"

# ---- sessions and messages ----


@query("SELECT conv_id AS session_id, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 20")
def f07_newest_sessions(spark: SparkSession, sf: str) -> DataFrame:
    sessions = messages(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))
    return store.top(sessions, 20, F.desc("last_turn"), "session_id")


@query("""SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS message_id,
 lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role) AS after_turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)""")
def e01_append_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of sessions that exist, numbered, each with the one it follows."""
    w = Window.partitionBy("session_id").orderBy("turn", "role")
    known = load(spark, sf, "documents").select(F.col("doc_id").alias("session_id"))
    rows = messages(spark, sf).join(known, "session_id", "left_semi")
    return rows.select("session_id", "turn", "role", F.row_number().over(w).alias("message_id"), F.lag("turn").over(w).alias("after_turn"))


@query("""SELECT c.conv_id AS session_id, c.turn, d.doc_id AS entry_id FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE contains(lower(c.text), 'the') AND contains(lower(d.text), 'the')""")
def j02_message_search_join(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a text search with the rows they belong to."""
    holds = F.contains(F.lower("content"), F.lit("the"))
    found = memories(spark, sf).where(holds).select("entry_id")
    return messages(spark, sf).where(holds).join(found, F.col("session_id") == F.col("entry_id")).select("session_id", "turn", "entry_id")


@query("""SELECT e.event_id, d.source AS scope_id, length(d.text) AS size FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) e LEFT JOIN documents d ON d.doc_id = e.user_id""")
def j09_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    """One lookup join in place of a read for each hit; hits without a memory stay."""
    hits = store.top(load(spark, sf, "events").select("event_id", "user_id", "ts"), 200, F.desc("ts"), F.desc("event_id"))
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), F.col("source").alias("scope_id"), F.char_length("text").alias("size"))
    return rows.join(F.broadcast(hits), "user_id", "right").select("event_id", "scope_id", "size")


# ---- media ----

_MEDIA_SQL = "md AS (SELECT page_id, url, html, CASE WHEN contains(html, '<img') THEN 'image' WHEN contains(html, '<table') THEN 'table' ELSE 'text' END AS kind FROM pages)"


def _media(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.contains("html", F.lit("<img")), "image").when(F.contains("html", F.lit("<table")), "table").otherwise("text")
    return load(spark, sf, "pages").select("page_id", "url", kind.alias("kind"))


@query(f"WITH {_MEDIA_SQL} SELECT kind, count(*) AS n FROM md GROUP BY kind")
def a13_media_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _media(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id FROM pages WHERE contains(url, 'no-such-word')), f AS (SELECT page_id FROM pages WHERE contains(lower(html), 'there') AND NOT EXISTS (SELECT 1 FROM p))
SELECT page_id FROM p UNION SELECT page_id FROM f ORDER BY page_id DESC LIMIT 500""")
def f09_media_search(spark: SparkSession, sf: str) -> DataFrame:
    """By address; only where that finds nothing, the newest by what they hold."""
    pages = load(spark, sf, "pages")
    first = pages.where(F.contains("url", F.lit("no-such-word"))).select("page_id")
    found = first.agg(F.count("*").alias("found"))  # one row
    second = pages.where(F.contains(F.lower("html"), F.lit("there"))).join(F.broadcast(found)).where("found = 0").select("page_id")
    return store.top(first.union(second).distinct(), 500, F.desc("page_id"))


# ---- chains ----

_TRAVERSE_SQL = """WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey % 50 AS b FROM orders), t AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.b, t.depth + 1 FROM t JOIN e ON e.a = t.node WHERE t.depth < 3)"""


@query(f"{_TRAVERSE_SQL} SELECT node, min(depth) AS depth FROM t GROUP BY node")
def j20_traverse(spark: SparkSession, sf: str) -> DataFrame:
    """What a memory leads to by its references within three steps; a reference is followed one way."""
    refs = load(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50).alias("b"))
    return graphs.reached(refs, spark.range(1, 2).select(F.col("id").alias("node")), 3)


@query(f"""{MEM}, r AS (SELECT entry_id, decay AS score FROM mem ORDER BY decay DESC, entry_id LIMIT 20), t AS (SELECT * FROM r WHERE score >= 0.3 ORDER BY score DESC, entry_id LIMIT 5),
x AS (SELECT entry_id // 2 AS entry_id, max(score) * 0.5 AS score FROM t GROUP BY entry_id // 2)
SELECT entry_id, round(score, 6) AS score, false AS expanded FROM r UNION ALL SELECT entry_id, round(score, 6), true FROM x WHERE entry_id NOT IN (SELECT entry_id FROM r) AND entry_id IN (SELECT entry_id FROM mem)""")
def r19_context_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """What the five best hits refer to joins the result at half their score; here a memory refers to the one of half its id."""
    rows = memories(spark, sf)
    hits = store.top(rows.select("entry_id", F.col("decay").alias("score")), 20, F.desc("score"), "entry_id")
    best = store.top(hits.where("score >= 0.3"), 5, F.desc("score"), "entry_id")
    led = best.groupBy(F.floor(F.col("entry_id") / 2).alias("entry_id")).agg((F.max("score") * 0.5).alias("score"))
    led = rows.select("entry_id").join(F.broadcast(led), "entry_id").join(F.broadcast(hits.select("entry_id")), "entry_id", "left_anti")
    out = hits.withColumn("expanded", F.lit(False)).unionByName(led.withColumn("expanded", F.lit(True)))
    return out.withColumn("score", F.round("score", 6))


@query(f"""{EV}, p AS (SELECT event_id, memory_id, kind, last_value(CASE WHEN kind = 'created' THEN event_id END IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
 first_value(CASE WHEN kind = 'promoted' THEN event_id END IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY "at", event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM ev)
SELECT 'fork' AS shape, up AS node, count(*) AS n FROM p WHERE kind = 'healed' AND up IS NOT NULL GROUP BY up HAVING count(*) > 1
UNION ALL SELECT 'merge', down, count(*) FROM p WHERE kind = 'healed' AND down IS NOT NULL GROUP BY down HAVING count(*) > 1""")
def a19_forks_and_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that several branches leave, and nodes that several run into."""
    w = Window.partitionBy("memory_id").orderBy("at", "event_id")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("event_id"))
    up = F.last(of("created"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    down = F.first(of("promoted"), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    branches = events(spark, sf).select("kind", up.alias("up"), down.alias("down")).where("kind = 'healed'")
    ends = branches.select(F.explode(F.array(F.struct(F.lit("fork").alias("shape"), F.col("up").alias("node")), F.struct(F.lit("merge").alias("shape"), F.col("down").alias("node")))).alias("end"))
    return ends.where("end.node IS NOT NULL").groupBy("end.shape", "end.node").agg(F.count("*").alias("n")).where("n > 1")


# ---- change logs ----

_STATUS_SQL = "CASE WHEN k >= 60 THEN 'done' WHEN k >= 5 THEN 'pending' ELSE 'conflict' END"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a log of changes: even ids are of this replica."""
    return events(spark, sf).select("event_id", "memory_id", "kind", "at", F.expr(_STATUS_SQL).alias("status"), F.when(F.col("event_id") % 2 == 0, "local").otherwise("remote").alias("node"))


@query(f"{EV} SELECT event_id, memory_id, kind, row_number() OVER (PARTITION BY memory_id ORDER BY \"at\", event_id) AS place FROM ev WHERE {_STATUS_SQL} = 'pending' AND event_id % 2 = 0")
def y03_push(spark: SparkSession, sf: str) -> DataFrame:
    """The pending changes of this replica for export; those of a memory in their order."""
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy("at", "event_id"))
    return _log(spark, sf).where("status = 'pending' AND node = 'local'").select("event_id", "memory_id", "kind", place.alias("place"))


@query(f"""{EV}, r AS (SELECT * FROM ev WHERE {_STATUS_SQL} = 'pending' AND event_id % 2 = 1), a AS (SELECT memory_id, "at" FROM ev WHERE {_STATUS_SQL} = 'done' AND event_id % 2 = 0)
SELECT event_id, memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY "at", event_id) AS place FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.memory_id = r.memory_id AND a."at" > r."at")""")
def y04_pull_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of the other replica that this one has not overtaken, in the order in which they apply."""
    log = _log(spark, sf)
    done = log.where("status = 'done' AND node = 'local'").groupBy("memory_id").agg(F.max("at").alias("done_at"))
    due = log.where("status = 'pending' AND node = 'remote'").join(done, "memory_id", "left").where("done_at IS NULL OR done_at <= at")
    return due.select("event_id", "memory_id", F.row_number().over(Window.partitionBy("memory_id").orderBy("at", "event_id")).alias("place"))


@query(f"{EV} SELECT event_id, memory_id FROM ev WHERE {_STATUS_SQL} = 'conflict' ORDER BY \"at\", event_id LIMIT 50")
def f11_oldest_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return store.top(_log(spark, sf).where("status = 'conflict'"), 50, "at", "event_id").select("event_id", "memory_id")


@query(f"""{EV} SELECT count(*) FILTER (s = 'pending') AS n_pending, count(*) FILTER (s = 'conflict') AS n_conflicts, count(*) FILTER (s = 'done') AS n_done, max("at") FILTER (s = 'done') AS last_synced
 FROM (SELECT *, {_STATUS_SQL} AS s FROM ev)""")
def y06_sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return _log(spark, sf).agg(of("pending").alias("n_pending"), of("conflict").alias("n_conflicts"), of("done").alias("n_done"), F.max(F.when(F.col("status") == "done", F.col("at"))).alias("last_synced"))


# ---- signals as sets ----

_SIGNALS_SQL = f"""{MEM}, s AS (SELECT entry_id, 'decay' AS signal, decay AS score FROM mem WHERE decay > 0.5 UNION ALL SELECT entry_id, 'hits', hits / 20.0 FROM mem WHERE hits >= 10 UNION ALL SELECT entry_id, 'hits', 0.55 FROM mem WHERE tier = 'pattern')"""


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    one = lambda where, name, score: rows.where(where).select("entry_id", F.lit(name).alias("signal"), score.alias("score"))
    return one("decay > 0.5", "decay", F.col("decay")).unionByName(one("hits >= 10", "hits", F.col("hits") / 20)).unionByName(one("tier = 'pattern'", "hits", F.lit(0.55)))


@query(f"{_SIGNALS_SQL} SELECT entry_id, max(score) FILTER (signal = 'decay') AS decay, max(score) FILTER (signal = 'hits') AS hits FROM s GROUP BY entry_id")
def j21_signal_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The best score of each signal of a candidate, as columns."""
    return _signals(spark, sf).groupBy("entry_id").pivot("signal", ["decay", "hits"]).agg(F.max("score"))


@query(f"{_SIGNALS_SQL} SELECT entry_id, round(sum(score), 6) AS score FROM (SELECT entry_id, signal, max(score) AS score FROM s GROUP BY ALL) GROUP BY entry_id ORDER BY round(sum(score), 6) DESC, entry_id LIMIT 10")
def k04_fused_top(spark: SparkSession, sf: str) -> DataFrame:
    """Fused scores, cut; the id settles ties."""
    best = _signals(spark, sf).groupBy("entry_id", "signal").agg(F.max("score").alias("score"))
    return store.top(best.groupBy("entry_id").agg(F.round(F.sum("score"), 6).alias("score")), 10, F.desc("score"), "entry_id")


@query(f"""{MEM}, h AS (SELECT entry_id, row_number() OVER (ORDER BY created_at DESC, entry_id) - 1 AS i FROM mem WHERE contains(lower(title || chr(10) || content), 'there') ORDER BY created_at DESC, entry_id LIMIT 50)
SELECT entry_id, round(1 - i / (SELECT count(*) FROM h)::DOUBLE * 0.5, 6) AS score FROM h""")
def r10_semantic_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Without a model of meaning, the fifty newest text matches fall from 1 to 0.5 by place."""
    hits = store.top(retrieval.text_match(memories(spark, sf), "there").select("entry_id", "created_at"), 50, F.desc("created_at"), "entry_id").withColumn("one", F.lit(1))
    return retrieval.place_signal(hits, "semantic", "one", 1.0, 0.5, 50, F.desc("created_at"), "entry_id").select("entry_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id DESC LIMIT 500), q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM v, q) SELECT * FROM s WHERE score > 0.2""")
def r09_semantic_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of a question with the 500 newest vectors, where above .2."""
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    newest = store.top(vectors, 500, F.desc("vec_id"))
    asked = vectors.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))  # one row
    norm = lambda c: F.sqrt(retrieval.dot(F.col(c), F.col(c)))
    scored = newest.join(F.broadcast(asked)).select("vec_id", F.round(F.try_divide(retrieval.dot(F.col("embedding"), F.col("q")), norm("embedding") * norm("q")), 6).alias("score"))
    return scored.where("score > 0.2")


@query("SELECT l_suppkey AS node FROM lineitem UNION SELECT s_suppkey FROM supplier")
def u02_distinct_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    left = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"))
    return left.union(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))).distinct()


@query("""WITH w AS (SELECT doc_id, generate_subscripts(t, 1) AS nr, unnest(t) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS t FROM documents)),
d AS (SELECT doc_id, word, min(nr) AS nr FROM w GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS place, word FROM d QUALIFY place <= 5""")
def u06_first_words(spark: SparkSession, sf: str) -> DataFrame:
    """The first five different words of a text, in order of their first place."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))
    return load(spark, sf, "documents").select("doc_id", F.posexplode(F.slice(words, 1, 5)).alias("place", "word")).select("doc_id", (F.col("place") + 1).alias("place"), "word")


# ---- streams ----


@query("SELECT event_id, user_id, event_type FROM events")
def stream_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    """A log that delivers every change twice; each is taken once within the watermark."""
    feed = replay.stream(spark, f"{sf}/events.parquet")
    once = replay.once(feed.union(feed), "ts", "365 days", "event_id")
    return replay.drain(once.select("event_id", "user_id", "event_type"), ["event_id"], mode="append")
