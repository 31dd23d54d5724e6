"""Histories, beliefs, replicas, condensation, curation, profiles and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import jaccard, latin_words
from tidemark.operators import graphs, history, retrieval, store
from tidemark.plans.graph_queries import _COOC_SQL, _cooc
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, MEMORIES_SQL, events, load, memories, messages
from tidemark.streaming import replay

MEM, EV = f"WITH {MEMORIES_SQL} ", f"WITH {EVENTS_SQL} "
IN_ORDER = ("at", "event_id")
NOW = 1704067200 + 400 * 60


# ---- history ----


@query(EV + 'SELECT * FROM (SELECT memory_id, lag(event_id) OVER (PARTITION BY memory_id ORDER BY "at", event_id) AS from_event, event_id AS to_event FROM ev) WHERE from_event IS NOT NULL')
def l01_event_chain(spark: SparkSession, sf: str) -> DataFrame:
    return history.chain(events(spark, sf), *IN_ORDER)


@query(EV + """, p AS (SELECT kind, last_value(CASE WHEN kind = 'created' THEN event_id END IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM ev)
SELECT parent, count(*) AS n FROM p WHERE kind = 'revised' AND parent IS NOT NULL GROUP BY parent HAVING count(*) > 1""")
def l03_forks(spark: SparkSession, sf: str) -> DataFrame:
    return history.branch_points(events(spark, sf), "created", "revised")


@query(EV + """SELECT memory_id, first(value ORDER BY "at" DESC, event_id DESC) FILTER (kind = 'promoted') AS value FROM ev GROUP BY memory_id""")
def l04_rollback(spark: SparkSession, sf: str) -> DataFrame:
    promoted = F.when(F.col("kind") == "promoted", F.struct("at", "event_id"))
    return events(spark, sf).groupBy("memory_id").agg(F.max_by("value", promoted).alias("value"))


@query(EV + """, s AS (SELECT memory_id, k - 50 AS d, sum(k - 50) OVER (PARTITION BY memory_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS s FROM ev)
SELECT memory_id, CAST(sum(d) - least(0, min(s)) AS BIGINT) AS weight FROM s GROUP BY memory_id""")
def a05_weight_changes(spark: SparkSession, sf: str) -> DataFrame:
    return history.clamped_sum(events(spark, sf).withColumn("d", F.col("k") - 50), "memory_id", "d", *IN_ORDER)


@query(EV + "SELECT kind, count(*) AS n, count(*) FILTER (k >= 50) AS n_active FROM ev GROUP BY kind")
def a21_type_stats(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 50).alias("n_active"))


@query(EV + "SELECT kind, k >= 50 AS severe, count(*) AS n FROM ev GROUP BY GROUPING SETS ((kind), (k >= 50), ())")
def a10_healer_stats(spark: SparkSession, sf: str) -> DataFrame:
    issues = events(spark, sf).select("kind", (F.col("k") >= 50).alias("severe"))
    return issues.groupingSets([["kind"], ["severe"], []], "kind", "severe").agg(F.count("*").alias("n"))


@query(EV + "SELECT memory_id, kind, count(*) AS n FROM ev GROUP BY ALL")
def g01_inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("memory_id", "kind").agg(F.count("*").alias("n"))


@query(EV + "SELECT event_id, round(value / (SELECT max(value) FROM ev), 6) AS score FROM ev")
def w12_max_normalise(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("event_id", "value")
    return ev.join(F.broadcast(ev.agg(F.max("value").alias("best")))).select("event_id", F.round(F.col("value") / F.col("best"), 6).alias("score"))  # one row


@query(EV + "SELECT event_id FROM ev ORDER BY event_id LIMIT 20 OFFSET 50")
def k02_offset_paging(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id").orderBy("event_id").offset(50).limit(20)


# ---- replicas ----

_LAST = '(SELECT memory_id, max("at") AS "at" FROM ev WHERE {} GROUP BY memory_id)'


def _last(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    return events(spark, sf).where(rule).groupBy("memory_id").agg(F.max("at").alias("at"))


@query(EV + f""", r AS {_LAST.format('k < 50')}, l AS {_LAST.format('k >= 40')}
SELECT r.memory_id, CASE WHEN l."at" > r."at" THEN 'conflict' WHEN l."at" = r."at" THEN 'skip' ELSE 'apply' END AS decision FROM r LEFT JOIN l USING (memory_id)""")
def y02_apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    return history.decide(_last(spark, sf, "k < 50"), _last(spark, sf, "k >= 40"))


@query(EV + "SELECT event_id FROM ev e WHERE k < 50 AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.memory_id = e.memory_id AND o.k >= 98)")
def y04_pull(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    return ev.where("k < 50").join(ev.where("k >= 98").select("memory_id"), "memory_id", "left_anti").select("event_id")


@query(EV + f""", o AS {_LAST.format('k < 90')}, n AS {_LAST.format("kind <> 'created'")}
SELECT coalesce(o.memory_id, n.memory_id) AS memory_id, CASE WHEN o.memory_id IS NULL THEN 'created' WHEN n.memory_id IS NULL THEN 'removed' ELSE 'updated' END AS change
FROM o FULL JOIN n ON o.memory_id = n.memory_id WHERE o."at" IS DISTINCT FROM n."at" """)
def o03_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return history.snapshot_diff(_last(spark, sf, "k < 90"), _last(spark, sf, "kind <> 'created'"), "memory_id", "at")


# ---- conversations ----


@query("""SELECT conv_id AS session_id, count(*) AS n, CAST(sum(length(role) + length(coalesce(text, '')) + 4) AS BIGINT) AS chars
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k > 3 GROUP BY conv_id""")
def d05_session_condense(spark: SparkSession, sf: str) -> DataFrame:
    old = history.condensable(messages(spark, sf), 3, F.desc("turn"), F.desc("role"), F.desc("content"))
    return old.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("role") + F.length(F.coalesce("content", F.lit(""))) + 4).alias("chars"))


@query("""SELECT conv_id AS session_id, turn, role, left(text, 80) AS head FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k <= 3""")
def d07_full_context(spark: SparkSession, sf: str) -> DataFrame:
    newest = store.per_key(messages(spark, sf), ["session_id"], 3, F.desc("turn"), F.desc("role"), F.desc("content"))
    return newest.select("session_id", "turn", "role", F.left("content", F.lit(80)).alias("head"))


@query("SELECT coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT count(*) - 3 AS n FROM conversations GROUP BY conv_id HAVING count(*) > 3)")
def a20_condensed_total(spark: SparkSession, sf: str) -> DataFrame:
    sizes = messages(spark, sf).groupBy("session_id").agg(F.count("*").alias("n")).where("n > 3")
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 3), F.lit(0)).alias("total"))


# ---- condensation, curation, healing, profiles ----


@query(MEM + "SELECT entry_id, created_at AS touched_at FROM mem WHERE touched_at < created_at")
def h08_auto_heal(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("touched_at < created_at").select("entry_id", F.col("created_at").alias("touched_at"))


@query(MEM + "SELECT entry_id, array_to_string(list_sort(list_distinct([coalesce(scope_id, ''), coalesce(tag, ''), tier, 'impression'])), ',') AS tags FROM mem")
def c02_merge_tags(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.coalesce(c, F.lit(""))
    both = F.array_union(F.array(some("scope_id"), some("tag")), F.array("tier", F.lit("impression")))
    return memories(spark, sf).select("entry_id", F.array_join(F.array_sort(both), ",").alias("tags"))


@query(MEM + f"SELECT scope_id, tag, created_at >= {NOW} - 14 * 60 AS is_dynamic, count(*) AS n, max(entry_id) AS latest FROM mem GROUP BY ALL")
def p01_profile(spark: SparkSession, sf: str) -> DataFrame:
    dynamic = (F.col("created_at") >= NOW - 14 * 60).alias("is_dynamic")
    return memories(spark, sf).groupBy("scope_id", "tag", dynamic).agg(F.count("*").alias("n"), F.max("entry_id").alias("latest"))


@query(MEM + f"""SELECT entry_id, round(least(1.0, decay + CASE tier WHEN 'impression' THEN CASE WHEN hits >= 10 THEN 0.25 ELSE -0.20 END WHEN 'pattern' THEN 0.15 ELSE 0 END), 6) AS score FROM mem
 ORDER BY score DESC, entry_id LIMIT 30""")
def t08_intent_rerank(spark: SparkSession, sf: str) -> DataFrame:
    bonus = F.when(F.col("tier") == "impression", F.when(F.col("hits") >= 10, 0.25).otherwise(-0.20)).when(F.col("tier") == "pattern", 0.15).otherwise(0.0)
    ranked = memories(spark, sf).select("entry_id", F.round(F.least(F.lit(1.0), F.col("decay") + bonus), 6).alias("score"))
    return store.top(ranked, 30, F.desc("score"), "entry_id")


@query(MEM + "SELECT entry_id, round(least(1.0, decay + least(0.15, hits * 0.01) * 0.1), 6) AS score FROM mem")
def r17_access_bonus(spark: SparkSession, sf: str) -> DataFrame:
    bonus = F.least(F.lit(0.15), F.col("hits") * 0.01) * 0.1
    return memories(spark, sf).select("entry_id", F.round(F.least(F.lit(1.0), F.col("decay") + bonus), 6).alias("score"))


@query(MEM + "SELECT entry_id, round(greatest(0.0, 1 - abs(created_at - 1704077200) / 7200.0), 6) AS score FROM mem WHERE created_at BETWEEN 1704070000 AND 1704084400 ORDER BY created_at DESC, entry_id LIMIT 100")
def r14_temporal_signal(spark: SparkSession, sf: str) -> DataFrame:
    near = store.by_time(memories(spark, sf), 1704070000, 1704084400, 100)
    return near.select("entry_id", F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("created_at") - 1704077200) / 7200.0), 6).alias("score"))


@query(MEM + "SELECT entry_id, round(1 - (row_number() OVER (ORDER BY hits DESC, entry_id) - 1) / 50.0 * 0.5, 6) AS score FROM (SELECT * FROM mem ORDER BY hits DESC, entry_id LIMIT 50)")
def w01_rank_decay(spark: SparkSession, sf: str) -> DataFrame:
    hits = store.top(memories(spark, sf).select("entry_id", "hits"), 50, F.desc("hits"), "entry_id")
    place = F.row_number().over(Window.orderBy(F.desc("hits"), "entry_id")) - 1  # 50 rows at most
    return hits.select("entry_id", F.round(1 - place / 50.0 * 0.5, 6).alias("score"))


@query(MEM + """SELECT entry_id, tier, decay, hits FROM mem WHERE tier = 'impression' UNION ALL SELECT entry_id, tier, 1.0, 0 FROM mem WHERE tier <> 'impression'""")
def u01_union_tiers(spark: SparkSession, sf: str) -> DataFrame:
    mem = memories(spark, sf).select("entry_id", "tier", "decay", "hits")
    lasting = mem.where("tier <> 'impression'").withColumns({"decay": F.lit(1.0), "hits": F.lit(0).cast("long")})
    return mem.where("tier = 'impression'").unionByName(lasting)


@query(MEM + "SELECT entry_id FROM mem WHERE hits >= 15 UNION SELECT entry_id FROM mem WHERE decay >= 0.9")
def u05_candidates(spark: SparkSession, sf: str) -> DataFrame:
    mem = memories(spark, sf)
    return mem.where("hits >= 15").select("entry_id").union(mem.where("decay >= 0.9").select("entry_id")).dropDuplicates(["entry_id"])


@query(MEM + "SELECT entry_id, CAST(floor((touched_at - created_at) / 86400.0) AS BIGINT) AS days FROM mem")
def x20_whole_days(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("entry_id", F.floor((F.col("touched_at") - F.col("created_at")) / 86400).alias("days"))


_SETS = "t AS (SELECT entry_id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(content), '[a-z]+')) AS b FROM mem)"


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda c: F.array_distinct(latin_words(c))
    return memories(spark, sf).select("entry_id", words(F.col("title")).alias("a"), words(F.col("content")).alias("b"))


@query(MEM + f", {_SETS} SELECT entry_id, len(list_intersect(a, b)) AS n_both, len(a) + len(b) - len(list_intersect(a, b)) AS n_any, len(b) - len(list_intersect(a, b)) AS n_new FROM t")
def u04_token_sets(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return _sets(spark, sf).select("entry_id", size(F.array_intersect("a", "b")).alias("n_both"), size(F.array_union("a", "b")).alias("n_any"), size(F.array_except("b", "a")).alias("n_new"))


@query(MEM + f", {_SETS} SELECT entry_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM t")
def x02_word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _sets(spark, sf).select("entry_id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(MEM + f", {_SETS} SELECT entry_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t")
def x05_keyword_f1(spark: SparkSession, sf: str) -> DataFrame:
    most = F.size("a") + F.size("b")
    return _sets(spark, sf).select("entry_id", F.round(F.when(most > 0, 2 * F.size(F.array_intersect("a", "b")) / most).otherwise(0.0), 6).alias("f1"))


@query("SELECT page_id, left(sha1(url), 16) AS media_id FROM pages")
def x17_media_id(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.left(F.sha1("url"), F.lit(16)).alias("media_id"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS n_refs FROM pages""")
def x21_references(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n_refs"))


@query("""SELECT doc_id, CAST(coalesce(list_sum([CAST(replace(x, ',', '') AS DECIMAL(38, 2)) FOR x IN regexp_extract_all(text, '[$] ?([0-9]{1,30}(?:,[0-9]{3})*(?:[.][0-9]{1,2})?)', 1)]), 0) AS DOUBLE) AS total,
 CAST(coalesce(list_sum([CAST(x AS DECIMAL(38, 0)) FOR x IN regexp_extract_all(text, '[0-9]+') IF len(x) <= 18]), 0) AS VARCHAR) AS numbers FROM documents""")
def a26_number_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the dollar amounts of a text, and of all its whole numbers of up to 18 digits."""
    sums = lambda found, kind: F.aggregate(found, F.lit(0).cast(kind), lambda s, x: (s + x.cast(kind)).cast(kind))
    money = F.transform(F.regexp_extract_all("text", F.lit("[$] ?([0-9]{1,30}(?:,[0-9]{3})*(?:[.][0-9]{1,2})?)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", ""))
    numbers = F.filter(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), lambda x: F.char_length(x) <= 18)
    return load(spark, sf, "documents").select("doc_id", F.coalesce(sums(money, "decimal(38,2)"), F.lit(0)).cast("double").alias("total"), F.coalesce(sums(numbers, "decimal(38,0)"), F.lit(0)).cast("string").alias("numbers"))


@query("SELECT doc_id AS entry_id FROM documents WHERE contains(lower(left(text, 80) || chr(10) || text), 'tion') AND contains(lower(left(text, 80) || chr(10) || text), 'there')")
def r02_text_match(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.text_match(memories(spark, sf), 'is "tion" AND (There)').select("entry_id")


# ---- graphs ----


@query("""SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, sum(l_quantity) AS weight, epoch_us(max(l_shipdate)) AS updated_at,
 last(l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) FILTER (l_returnflag <> 'N') AS metadata FROM lineitem GROUP BY ALL""")
def a04_edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    meaningful = F.when(F.col("l_returnflag") != "N", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return load(spark, sf, "lineitem").groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg(
        F.sum("l_quantity").alias("weight"), F.unix_micros(F.max("l_shipdate").cast("timestamp")).alias("updated_at"), F.max_by("l_returnflag", meaningful).alias("metadata"))


@query(f"WITH {_COOC_SQL} SELECT count(*) AS n_edges, (SELECT count(*) FROM (SELECT a FROM co UNION SELECT b FROM co)) AS n_nodes, round(avg(weight), 3) AS mean_weight FROM co")
def a07_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.stats(_cooc(spark, sf))


@query(f"WITH {_COOC_SQL} SELECT a, b, weight FROM co WHERE a = 1 OR b = 1 ORDER BY weight DESC, a, b LIMIT 10")
def g11_ego_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.ego(_cooc(spark, sf), 1, 10)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Every creation links its memory with one that its counter names; pairs made twice or more are strong."""
    ev = events(spark, sf).where("kind = 'created'")
    return ev.groupBy(F.least("memory_id", F.col("memory_id") + 1 + F.col("k")).alias("a"), F.greatest("memory_id", F.col("memory_id") + 1 + F.col("k")).alias("b")).agg((F.count("*") / 2).alias("weight"))


@query()
def g10_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the edges of weight .5 or more, two members or more. Recursive SQL is too slow on the whole table; tests hold it to union-find."""
    members = graphs.communities(_links(spark, sf).where("weight >= 0.5"))
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    return members.join(size.where("size >= 2"), "community").select("node", "community", "size")


@query()
def g09_path_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Least number of steps, up to six, from the smallest memory; tests hold it to a breadth-first walk."""
    links = _links(spark, sf)
    return graphs.neighbours(links, links.agg(F.min("a").alias("node")), 6)


# ---- streams ----


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    feed = replay.stream(spark, f"{sf}/events.parquet")
    counted = replay.drain(replay.windowed_counts(feed, "ts", "1 hour", "365 days", "event_type"), ["start", "event_type"])
    return counted.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_current_state(spark: SparkSession, sf: str) -> DataFrame:
    feed = replay.stream(spark, f"{sf}/events.parquet")
    return replay.drain(replay.current_state(feed, ["user_id", "event_type"], "event_id", F.struct("ts", "event_id")), ["user_id", "event_type"])
