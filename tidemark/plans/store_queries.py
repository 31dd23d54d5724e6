"""Scans, filters, top-k, set operations and aggregates of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, MEMORIES_SQL, events, load, memories, messages

MEM, EV = f"WITH {MEMORIES_SQL} ", f"WITH {EVENTS_SQL} "
RANK = "CASE tier WHEN 'impression' THEN 0 WHEN 'pattern' THEN 1 ELSE 2 END"


@query(MEM + "SELECT entry_id, tier, title FROM mem WHERE entry_id IN (7, 10, 21)")
def s02_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.col("entry_id").isin(7, 10, 21)).select("entry_id", "tier", "title")


@query(MEM + "SELECT entry_id, created_at FROM mem WHERE tier = 'impression' ORDER BY created_at DESC, entry_id LIMIT 100")
def s03_recent_scan(spark: SparkSession, sf: str) -> DataFrame:
    return store.top(memories(spark, sf).where("tier = 'impression'"), 100, F.desc("created_at"), "entry_id").select("entry_id", "created_at")


@query(MEM + "SELECT tier, count(*) AS n FROM mem WHERE tier <> 'impression' GROUP BY tier")
def s04_tier_routing(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("tier <> 'impression'").groupBy("tier").agg(F.count("*").alias("n"))


@query(EV + "SELECT event_id, k FROM ev WHERE k >= 50")
def s05_json_codec(spark: SparkSession, sf: str) -> DataFrame:
    parsed = load(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.where("p.k >= 50").select("event_id", "p.k")


@query(EV + "SELECT memory_id, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY \"at\" DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1")
def s07_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(events(spark, sf), "memory_id", F.desc("at"), F.desc("event_id")).select("memory_id", "kind", "value")


@query(MEM + "SELECT count(*) AS total, count(*) FILTER (trim(content) <> '') AS imported, count(*) FILTER (trim(content) = '') AS skipped FROM mem")
def s08_bulk_import(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.trim("content") == ""
    return memories(spark, sf).agg(F.count("*").alias("total"), F.count_if(~blank).alias("imported"), F.count_if(blank).alias("skipped"))


@query("""WITH m AS (SELECT conv_id, turn, role, left(text, 500) AS part FROM conversations WHERE (role = 'user' AND length(text) >= 3) OR (role = 'assistant' AND length(text) >= 5)),
r AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn, role, part ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM m)
SELECT conv_id AS session_id, count(*) AS n_kept, CAST(sum(length(part)) AS BIGINT) AS chars FROM r WHERE n >= 2 AND upto <= 2000 GROUP BY conv_id""")
def s09_conversation_import(spark: SparkSession, sf: str) -> DataFrame:
    useful = messages(spark, sf).where("(role = 'user' AND length(content) >= 3) OR (role = 'assistant' AND length(content) >= 5)").withColumn("part", F.left("content", F.lit(500)))
    w = Window.partitionBy("session_id")
    budget = useful.withColumn("upto", F.sum(F.length("part")).over(w.orderBy("turn", "role", "part").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(w))
    return budget.where("n >= 2 AND upto <= 2000").groupBy("session_id").agg(F.count("*").alias("n_kept"), F.sum(F.length("part")).alias("chars"))


@query("SELECT conv_id AS scope_id, turn, left(text, 50) || '...' AS title, 'auto-extracted,' || role AS tags FROM conversations WHERE text <> ''")
def s10_chat_extract(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).where("content <> ''").select(F.col("session_id").alias("scope_id"), "turn", F.concat(F.left("content", F.lit(50)), F.lit("...")).alias("title"), F.concat(F.lit("auto-extracted,"), "role").alias("tags"))


@query(MEM + f"""SELECT entry_id, tier, decay FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY decay DESC, touched_at DESC, entry_id) AS rn FROM mem WHERE scope_id = 'src3')
 WHERE rn <= 20 ORDER BY decay DESC, touched_at DESC, entry_id LIMIT 20""")
def f01_scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_scope(memories(spark, sf), "src3", 20).select("entry_id", "tier", "decay")


@query(MEM + "SELECT entry_id, created_at FROM mem WHERE created_at >= 1704070000 AND created_at <= 1704085000")
def f02_time_range(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_time(memories(spark, sf), 1704070000, 1704085000).select("entry_id", "created_at")


@query(MEM + f"""SELECT entry_id, tier, decay FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY decay, touched_at DESC, entry_id) AS rn FROM mem WHERE decay BETWEEN 0 AND 0.3)
 WHERE rn <= 25 ORDER BY {RANK}, rn LIMIT 25""")
def f03_decay_band(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_decay(memories(spark, sf), 0.0, 0.3, 25).select("entry_id", "tier", "decay")


@query(MEM + "SELECT entry_id FROM mem WHERE content ILIKE '%nation%' OR title ILIKE '%nation%'")
def f05_text_like(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.col("content").ilike("%nation%") | F.col("title").ilike("%nation%")).select("entry_id")


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%.html' OR url ILIKE '%/a%'")
def f08_media_filter(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").where(F.col("url").ilike("%.html") | F.col("url").ilike("%/a%")).select("page_id", "url")


@query(EV + "SELECT event_id, kind, \"at\" FROM ev WHERE memory_id = 42")
def f10_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("memory_id = 42").select("event_id", "kind", "at")


@query("""WITH q AS (SELECT ['the', 'and', 'nation', 'thing'] AS w), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)
SELECT doc_id AS entry_id, CAST(len(list_intersect(t, w)) AS INTEGER) AS overlap FROM d, q WHERE len(list_intersect(t, w)) > 0 ORDER BY overlap DESC, doc_id LIMIT 50""")
def f12_keyword_overlap(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.text import latin_words

    words = F.array(*map(F.lit, ("the", "and", "nation", "thing")))
    hit = memories(spark, sf).select("entry_id", F.size(F.array_intersect(F.array_distinct(latin_words(F.col("content"))), words)).alias("overlap"))
    return store.top(hit.where("overlap > 0"), 50, F.desc("overlap"), "entry_id")


@query("SELECT conv_id AS session_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 30 OFFSET 60")
def k02_paging(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).orderBy("session_id", "turn").offset(60).limit(30).select("session_id", "turn")


@query(MEM + "SELECT entry_id, 'keep' AS side FROM mem WHERE tier <> 'impression' UNION SELECT entry_id, 'keep' AS side FROM mem WHERE decay > 0.9")
def u03_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    return m.where("tier <> 'impression'").select("entry_id").union(m.where("decay > 0.9").select("entry_id")).distinct().withColumn("side", F.lit("keep"))


@query(MEM + "SELECT tier, scope_id, count(*) AS n, avg(hits) AS hits FROM mem GROUP BY GROUPING SETS ((tier, scope_id), (tier), ())")
def a01_store_counts(spark: SparkSession, sf: str) -> DataFrame:
    memories(spark, sf).createOrReplaceTempView("tidemark_memories")
    return spark.sql("SELECT tier, scope_id, count(*) AS n, avg(hits) AS hits FROM tidemark_memories GROUP BY GROUPING SETS ((tier, scope_id), (tier), ())")


@query("SELECT label, count(*) AS n, round(avg(len(embedding)), 6) AS dim FROM embeddings GROUP BY label")
def a02_embedding_stats(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 6).alias("dim"))


@query(EV + "SELECT kind, count(*) AS n, count(DISTINCT memory_id) AS memories, max(\"at\") AS last_at FROM ev GROUP BY kind")
def a11_timeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("memories"), F.max("at").alias("last_at"))


@query(EV + "SELECT event_id % 3 AS node, count(*) FILTER (kind = 'created') AS created, count(*) FILTER (kind = 'revised') AS revised, max(\"at\") FILTER (kind = 'revised') AS last_revised FROM ev GROUP BY 1")
def a12_sync_status(spark: SparkSession, sf: str) -> DataFrame:
    revised = F.col("kind") == "revised"
    return events(spark, sf).groupBy((F.col("event_id") % 3).alias("node")).agg(F.count_if(F.col("kind") == "created").alias("created"), F.count_if(revised).alias("revised"), F.max(F.when(revised, F.col("at"))).alias("last_revised"))


@query(MEM + "SELECT d AS day, n FROM (SELECT created_at // 86400 AS d, count(*) AS n FROM mem GROUP BY 1 ORDER BY d DESC LIMIT 30)")
def a14_daily_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).groupBy(F.expr("created_at div 86400").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(30)


@query(MEM + "SELECT CASE WHEN decay >= 0.8 THEN 'fresh' WHEN decay >= 0.5 THEN 'active' WHEN decay >= 0.2 THEN 'fading' ELSE 'forgotten' END AS band, count(*) AS n FROM mem GROUP BY 1")
def a16_decay_bands(spark: SparkSession, sf: str) -> DataFrame:
    return store.decay_bands(memories(spark, sf))


@query(MEM + "SELECT created_at // 86400 AS day, count(*) FILTER (tier = 'impression') AS impression, count(*) FILTER (tier = 'pattern') AS pattern, count(*) FILTER (tier = 'principle') AS principle FROM mem GROUP BY 1")
def a17_tier_day_pivot(spark: SparkSession, sf: str) -> DataFrame:
    counted = memories(spark, sf).groupBy(F.expr("created_at div 86400").alias("day")).pivot("tier", ["impression", "pattern", "principle"]).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


@query("""WITH w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS tag FROM documents), c AS (SELECT source, tag, count(*) AS n FROM w GROUP BY ALL)
SELECT source AS scope_id, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tag) AS rn FROM c) WHERE rn <= 5""")
def a22_tag_frequency(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.text import latin_words

    tags = memories(spark, sf).select("scope_id", F.explode(F.array_distinct(latin_words(F.col("content")))).alias("tag"))
    return store.per_key(tags.groupBy("scope_id", "tag").agg(F.count("*").alias("n")), ["scope_id"], 5, F.desc("n"), "tag").drop("rn")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), p AS (SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY token)
SELECT token, df, tf FROM p WHERE df >= 5""")
def a24_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.retrieval import postings

    rows = postings(memories(spark, sf))
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where("df >= 5 AND token RLIKE '^[a-z]+$'")


@query("SELECT conv_id AS session_id, CAST(sum(floor(length(text) * 0.5)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def a27_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).groupBy("session_id").agg(F.sum(F.floor(F.length("content") * 0.5)).cast("long").alias("tokens"))


@query(MEM + "SELECT entry_id, round(greatest(0, CASE WHEN touched_at < 1704080000 THEN decay - 0.25 ELSE decay END), 6) AS decay FROM mem")
def t10_decay_idle(spark: SparkSession, sf: str) -> DataFrame:
    return store.decay_idle(memories(spark, sf), 0.25, 1704080000).select("entry_id", F.round("decay", 6).alias("decay"))


@query(f"WITH {MEMORIES_SQL}, {EVENTS_SQL}, a AS (SELECT memory_id, count(*) AS n FROM ev GROUP BY 1) SELECT entry_id, hits + coalesce(n, 0) AS hits, round(least(1.0, decay + 0.05 * coalesce(n, 0)), 6) AS decay FROM mem LEFT JOIN a ON memory_id = entry_id")
def t11_touch(spark: SparkSession, sf: str) -> DataFrame:
    accesses = events(spark, sf).select(F.col("memory_id").alias("entry_id"), F.expr("at div 1000000").alias("at"))
    return store.touch(memories(spark, sf), accesses).select("entry_id", "hits", F.round("decay", 6).alias("decay"))


@query(MEM + "SELECT entry_id FROM mem WHERE NOT (decay <= 0 AND created_at < 1704080000)")
def t12_purge(spark: SparkSession, sf: str) -> DataFrame:
    return store.purge(memories(spark, sf), 1704080000).select("entry_id")
