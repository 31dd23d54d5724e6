"""What is taken out of texts: names, beliefs, facts, dates, numbers, hashed vectors; and the re-ranking by what a question is after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import extraction
from tidemark.operators import retrieval, store
from tidemark.plans.memory_queries import TYPED_SQL, _case, _typed
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES_SQL, load, memories, messages

MEM = f"WITH {MEMORIES_SQL}"


@query()
def g03_named_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Names in every memory, by kind; SQL has no places of matches, so tests hold it to sentences."""
    tagged = memories(spark, sf).select("entry_id", F.posexplode(extraction.named_entities(F.col("content"))).alias("place", "name"))
    return tagged.select("entry_id", "place", "name.label", "name.kind")


@query("""WITH g AS (SELECT DISTINCT item_id, substr(t, i, n) AS run FROM (SELECT item_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM benchmark), (SELECT unnest([1, 2, 3, 4]) AS n)
 WHERE i + n - 1 <= length(t)), h AS (SELECT item_id, md5(run) AS md FROM g),
m AS (SELECT item_id, (CAST('0x' || substr(md, 8 * k + 1, 2) AS BIGINT) + 256 * CAST('0x' || substr(md, 8 * k + 3, 2) AS BIGINT)) % 1024 AS dim,
 CASE WHEN CAST('0x' || substr(md, 2 * k + 1, 2) AS BIGINT) >= 128 THEN 1 ELSE -1 END AS by_ FROM h, (SELECT unnest([0, 1, 2, 3]) AS k)),
s AS (SELECT item_id, dim, sum(by_) AS v FROM m GROUP BY item_id, dim)
SELECT item_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM s WHERE v <> 0""")
def r21_hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    vectors = extraction.hash_embedding(load(spark, sf, "benchmark"), "item_id", "text")
    return vectors.select("item_id", "dim", F.round("value", 6).alias("value"))


_BELIEF_COUNTS = " + ".join(f"len(regexp_extract_all(content, '{cue}', 1))" for _, cue in extraction.BELIEFS)


@query(f"""{MEM} SELECT entry_id, title, left(content, 200) AS summary, least(10, len(regexp_extract_all(content, '{extraction.NAMED_IN_TEXT}', 1))) AS n_names, {_BELIEF_COUNTS} AS n_beliefs FROM mem""")
def e02_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A text as a memory: title, summary, announced names and beliefs."""
    text = F.col("content")
    return memories(spark, sf).select(
        "entry_id", "title", F.left(text, F.lit(200)).alias("summary"), F.size(extraction.names_after(text)).cast("long").alias("n_names"), F.size(extraction.beliefs(text)).cast("long").alias("n_beliefs")
    )


@query(f"""SELECT conv_id AS session_id, turn, len(regexp_extract_all(text, '{extraction.KEYWORDS}')) AS n_keywords, array_to_string(regexp_extract_all(text, '{extraction.KEYWORDS}')[1:5], ' ') AS first_keywords,
 len(regexp_extract_all(text, '{extraction.NAMED_IN_QUESTION}', 1)) AS n_names FROM conversations WHERE role = 'user'""")
def r06_query_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """What a question looks for."""
    words = extraction.keywords(F.col("content"))
    names = F.regexp_extract_all("content", F.lit(extraction.NAMED_IN_QUESTION), F.lit(1))
    return messages(spark, sf).where("role = 'user'").select(
        "session_id", "turn", F.size(words).cast("long").alias("n_keywords"), F.array_join(F.slice(words, 1, 5), " ").alias("first_keywords"), F.size(names).cast("long").alias("n_names")
    )


_CUE = "nation|there"
_NEAR_SQL = f"""{MEM}, p AS (SELECT entry_id, content, length(regexp_extract(content, '(?s)^(.*?)(?:{_CUE})', 1)) AS s, length(regexp_extract(content, '(?s)^(.*?(?:{_CUE}))', 1)) AS e FROM mem),
n AS (SELECT entry_id, content, e > 0 AS hit, trim(substr(content, greatest(0, s - 5) + 1, e + 40 - greatest(0, s - 5))) AS near FROM p)"""


@query(f"""{_NEAR_SQL} SELECT entry_id, CASE WHEN NOT hit THEN left(content, 80) WHEN instr(near, '。') > 1 THEN left(near, instr(near, '。')) WHEN instr(near, '！') > 1 THEN left(near, instr(near, '！'))
 WHEN instr(near, '？') > 1 THEN left(near, instr(near, '？')) WHEN instr(near, '.') > 1 THEN left(near, instr(near, '.')) WHEN instr(near, '!') > 1 THEN left(near, instr(near, '!'))
 WHEN instr(near, '?') > 1 THEN left(near, instr(near, '?')) ELSE near END AS snippet FROM n""")
def x15_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select("entry_id", extraction.fact(F.col("content"), _CUE).alias("snippet"))


@query(f"{MEM} SELECT scope_id, {_case('content', extraction.FACTS, 'other')} AS category, count(*) AS n, arg_max(title, (created_at, entry_id)) AS newest FROM mem GROUP BY ALL")
def p01_fact_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of a scope by category, and the newest of each."""
    category = None
    for name, cue in extraction.FACTS:
        hit = F.col("content").rlike(cue)
        category = F.when(hit, name) if category is None else category.when(hit, name)
    rows = memories(spark, sf).select("scope_id", category.otherwise("other").alias("category"), "title", "created_at", "entry_id")
    return rows.groupBy("scope_id", "category").agg(F.count("*").alias("n"), F.max_by("title", F.struct("created_at", "entry_id")).alias("newest"))


@query(f"""{MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, tag ORDER BY created_at DESC, entry_id DESC) AS k FROM mem)
SELECT scope_id, tag, tag || ': ' || string_agg(title, '; ' ORDER BY k) AS line FROM r WHERE k <= 3 GROUP BY scope_id, tag""")
def p02_profile_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line a group: its three newest facts."""
    ranked = store.per_key(memories(spark, sf).select("scope_id", "tag", "title", "created_at", "entry_id"), ["scope_id", "tag"], 3, F.desc("created_at"), F.desc("entry_id"), rank="place")
    facts = F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"])  # three at most
    return ranked.groupBy("scope_id", "tag").agg(F.concat(F.first("tag"), F.lit(": "), F.array_join(facts, "; ")).alias("line"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ',' || strftime(o_orderdate, '%b ') || day(o_orderdate) || ',' || strftime(o_orderdate, '%B ') || day(o_orderdate)
 || ',' || month(o_orderdate) || '/' || day(o_orderdate) || ',' || month(o_orderdate) || '-' || day(o_orderdate) AS variants FROM orders""")
def x09_date_variants(spark: SparkSession, sf: str) -> DataFrame:
    said = F.date_format("o_orderdate", "MMMM d")
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(extraction.date_variants(said), ",").alias("variants"))


_NAMED = "|".join(sorted(extraction.NUMBERS, key=len, reverse=True))
_VALUES = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in extraction.NUMBERS.items()) + "}"
_SAID_SQL = f"s AS (SELECT p_partkey, p_name || ' ' || p_size || ' one hundred' AS said FROM part), w AS (SELECT p_partkey, unnest(regexp_extract_all(said, '\\b([0-9]{{1,18}}|{_NAMED})\\b', 1)) AS w FROM s)"


@query(f"WITH {_SAID_SQL} SELECT p_partkey, count(*) AS n, CAST(sum(coalesce({_VALUES}[w], TRY_CAST(w AS BIGINT))) AS BIGINT) AS total FROM w GROUP BY p_partkey")
def x12_named_numbers(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("one hundred"))
    numbers = load(spark, sf, "part").select("p_partkey", F.explode(extraction.named_numbers(said)).alias("v"))
    return numbers.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


_DURATION = "([0-9]+ +(?:days?|weeks?|months?|years?|hours?|minutes?))"


@query(f"""SELECT l_orderkey, l_linenumber, regexp_extract('shipped after ' || date_diff('day', o_orderdate, l_shipdate) || ' days', '{_DURATION}', 1) AS duration
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def x11_duration(spark: SparkSession, sf: str) -> DataFrame:
    """A span of time as a text says it."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    said = F.concat(F.lit("shipped after "), F.date_diff("l_shipdate", "o_orderdate").cast("string"), F.lit(" days"))
    return load(spark, sf, "lineitem").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", F.regexp_extract(said, _DURATION, 1).alias("duration"))


_INTENT = "CASE entry_id % 6 WHEN 0 THEN 'current_state' WHEN 1 THEN 'historical_range' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'duration' WHEN 4 THEN 'specific_date' ELSE 'any' END"
_NOW = 1704067200 + 40 * 86400


@query(f"""{TYPED_SQL}, a AS (SELECT entry_id, decay, {_INTENT} AS intent, memory_type, memory_type <> 'event' AS active, CASE WHEN memory_type IN ('state', 'plan', 'event') THEN created_at + entry_id % 90 * 86400 END AS st,
 CASE WHEN memory_type = 'event' THEN created_at + entry_id % 90 * 86400 END AS en FROM ty), d AS (SELECT *, CAST(floor(({_NOW} - st) / 86400.0) AS BIGINT) AS ago, CAST(floor((st - {_NOW}) / 86400.0) AS BIGINT) AS ahead FROM a),
b AS (SELECT *, CASE intent WHEN 'current_state' THEN CASE WHEN memory_type = 'state' AND active THEN 0.25 WHEN memory_type = 'preference' THEN 0.15 WHEN NOT active THEN -0.2 ELSE 0 END
 WHEN 'historical_range' THEN CASE WHEN memory_type = 'event' THEN 0.15 ELSE 0 END + CASE WHEN st IS NOT NULL THEN 0.05 * least(ago / 30.0, 1.0) ELSE 0 END
 WHEN 'upcoming' THEN CASE WHEN memory_type = 'plan' AND active THEN 0.3 ELSE 0 END + CASE WHEN st > {_NOW} THEN 0.1 * greatest(1.0 - ahead / 14.0, 0) ELSE 0 END
 WHEN 'duration' THEN CASE WHEN memory_type = 'state' AND st IS NOT NULL THEN 0.1 * least(coalesce(floor((en - st) / 86400.0), ago) / 365.0, 1.0) ELSE 0 END
 WHEN 'specific_date' THEN CASE WHEN st IS NOT NULL THEN 0.1 ELSE 0 END ELSE 0 END AS bonus FROM d)
SELECT entry_id, intent, round(CASE WHEN intent = 'any' THEN decay ELSE least(1.0, decay + bonus * CASE WHEN ago > 0 THEN pow(0.5, ago / 30.0) ELSE 1 END) END, 6) AS score FROM b""")
def t08_rerank_intents(spark: SparkSession, sf: str) -> DataFrame:
    """All five intents: every memory is scored as if a question of one of them had found it; times are spread over ninety days around now."""
    start = F.when(F.col("memory_type").isin("state", "plan", "event"), F.col("created_at") + F.col("entry_id") % 90 * 86400)
    rows = _typed(spark, sf).select("entry_id", F.col("decay").alias("score"), F.expr(_INTENT).alias("intent"), "memory_type", (F.col("memory_type") != "event").alias("is_active"), start.alias("starts_at"))
    rows = rows.withColumn("ends_at", F.when(F.col("memory_type") == "event", F.col("starts_at")))
    return rows.select("entry_id", "intent", F.round(retrieval.intent_score(F.lit(_NOW)), 6).alias("score"))
