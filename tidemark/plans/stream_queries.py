"""Streams with state of their own: keyed states, merged snapshots, tables written together, marks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.extraction import BELIEFS as BELIEF_CUES
from tidemark.functions.extraction import beliefs
from tidemark.functions.text import memory_type, state_key
from tidemark.operators.condensation import LOG, condense
from tidemark.operators.graphs import cooccurrence
from tidemark.operators.lineage import cut, shared_folder
from tidemark.plans.memory_queries import _STATES_SQL, TYPED_SQL
from tidemark.plans.registry import query
from tidemark.sources.tables import messages
from tidemark.streaming import keyed_state, replay, sessions
from tidemark.streaming.batch_store import BatchStore, plus, run

EDGES, EDGE_COMBINE = "a bigint, b bigint, weight double, n bigint, last_at bigint", {"weight": plus, "n": plus, "last_at": F.greatest}
COUNTS, COUNT_COMBINE = "label string, n bigint", {"n": plus}
MET, STATES, BELIEFS = "a string, b string, weight bigint", "key string, newest bigint, n bigint", "entry_id bigint, content string, confidence string"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def state_feed(feed: DataFrame) -> DataFrame:
    kinds = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'touched' WHEN 'click' THEN 'revised' WHEN 'purchase' THEN 'promoted' ELSE 'healed' END"
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.lit("state"), F.expr(kinds))
    return feed.select("event_id", key.alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(f"""{_STATES_SQL} SELECT key, arg_max(event_id, ("at", event_id)) AS event_id, max("at") AS "at", arg_max(k, ("at", event_id)) AS k, count(*) - 1 AS n_closed, false AS is_idle FROM st GROUP BY key""")
def stream_keyed_states(spark: SparkSession, sf: str) -> DataFrame:
    """T07, T10 as a stream: of each key the newest state and how many it closed; the replay's watermark lies too far back for an idle one."""
    feed = replay.stream(spark, f"{sf}/events.parquet", 1)
    return keyed_state.follow_states(state_feed(feed), _folder(spark, "states"), "3650 days", 3650 * 86400)


def edges_of(batch: DataFrame, store: BatchStore) -> dict[str, DataFrame]:
    """Edge upserts of a batch of line items: weights and counts add up, the last time wins."""
    changes = batch.groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg(
        F.sum(F.col("l_quantity").cast("double")).alias("weight"), F.count("*").alias("n"), F.max(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("last_at")
    )
    return {"edges": store.merged("edges", EDGES, ["a", "b"], changes, EDGE_COMBINE)}


@query("SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, round(sum(l_quantity::DOUBLE), 6) AS weight, count(*) AS n, epoch_us(max(l_shipdate)) AS last_at FROM lineitem GROUP BY ALL")
def stream_edge_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of line items merged into one row an edge."""
    store = BatchStore(spark, _folder(spark, "edges"))
    run(replay.stream(spark, f"{sf}/lineitem.parquet", 1), store, edges_of)
    return store.snapshot("edges", EDGES).select("a", "b", F.round("weight", 6).alias("weight"), "n", "last_at")


def memory_write(batch: DataFrame, store: BatchStore) -> dict[str, DataFrame]:
    """All that one batch of new memories writes: typed rows, the entity index, how often each entity occurs and with which others, the beliefs that texts state, and
    of every state key the newest memory and how many there were; all but the newest are closed. Ids rise with time."""
    # a batch is a file or two, so its texts are dealt to all tasks; each is read once, and what it gives is kept
    dealt = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("scope_id"), F.left("text", F.lit(80)).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{6,})"), F.lit(1)))
    typed = rows.select("*", memory_type(F.col("content")).alias("memory_type"), words.alias("labels"), beliefs(F.col("content")).alias("beliefs"))
    key = F.when(F.col("memory_type") == "state", state_key(F.coalesce("scope_id", F.lit("")), F.col("content")))
    typed = cut(typed.select("entry_id", "scope_id", "memory_type", F.char_length("content").alias("chars"), "labels", "beliefs", key.alias("key")))
    labels = typed.select("entry_id", F.explode("labels").alias("label"))
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    keys = typed.where("memory_type = 'state'").groupBy("key")
    return {
        "memories": typed.select("entry_id", "scope_id", "memory_type", "chars"),
        "entities": labels,
        "label_counts": store.merged("label_counts", COUNTS, ["label"], counts, COUNT_COMBINE),
        "cooccurrences": store.merged("cooccurrences", MET, ["a", "b"], cooccurrence(labels, "entry_id", "label"), {"weight": plus}),
        "beliefs": typed.select("entry_id", F.inline("beliefs")).select("entry_id", "content", "confidence"),
        "states": store.merged("states", STATES, ["key"], keys.agg(F.max("entry_id").alias("newest"), F.count("*").alias("n")), {"newest": F.greatest, "n": plus}),
    }


MEMORIES, ENTITIES = "entry_id bigint, scope_id string, memory_type string, chars int", "entry_id bigint, label string"


@query(f"""{TYPED_SQL}, el AS (SELECT entry_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{{6,}}'))) AS label FROM ty), ec AS (SELECT label, count(*) AS n FROM el GROUP BY label)
SELECT memory_type, count(DISTINCT entry_id) AS n_memories, count(label) AS n_links, max(n) AS most FROM ty LEFT JOIN el USING (entry_id) LEFT JOIN ec USING (label) GROUP BY memory_type""")
def s06_composite_write(spark: SparkSession, sf: str) -> DataFrame:
    """New memories written with their entities and counts, all tables of a batch or none; read back joined."""
    store = BatchStore(spark, _folder(spark, "write"))
    run(replay.stream(spark, f"{sf}/documents.parquet", 1), store, memory_write, once=True)
    rows, links, counts = store.read("memories", MEMORIES).drop("batch"), store.read("entities", ENTITIES).drop("batch"), store.snapshot("label_counts", COUNTS).select("label", "n")
    joined = rows.join(links, "entry_id", "left").join(counts, "label", "left")
    return joined.groupBy("memory_type").agg(F.countDistinct("entry_id").alias("n_memories"), F.count("label").alias("n_links"), F.max("n").alias("most"))


@query(f"""{TYPED_SQL}, el AS (SELECT entry_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{{6,}}'))) AS label FROM ty)
SELECT 'met' AS item, x.label || ' ' || y.label AS name, count(*) AS n FROM el x JOIN el y ON x.entry_id = y.entry_id AND x.label < y.label GROUP BY ALL
UNION ALL SELECT 'state', key, count(*) FROM ty WHERE memory_type = 'state' GROUP BY key
UNION ALL SELECT 'belief', level, count(*) FROM (SELECT level, unnest(regexp_extract_all(content, cue, 1)) FROM ty, (VALUES {", ".join(f"('{level}', '{cue}')" for level, cue in BELIEF_CUES)}) c(level, cue)) GROUP BY level""")
def s06_written_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What the write leaves in its merged tables and in the belief log."""
    store = BatchStore(spark, _folder(spark, "written"))
    run(replay.stream(spark, f"{sf}/documents.parquet", 1), store, memory_write, once=True)
    named = lambda rows, item, name, n: rows.select(F.lit(item).alias("item"), name.alias("name"), n.alias("n"))
    met = named(store.snapshot("cooccurrences", MET), "met", F.concat_ws(" ", "a", "b"), F.col("weight"))
    states = named(store.snapshot("states", STATES), "state", F.col("key"), F.col("n"))
    said = store.read("beliefs", BELIEFS).groupBy("confidence").agg(F.count("*").alias("n"))
    return met.union(states).union(named(said, "belief", F.col("confidence"), F.col("n")))


@query("""WITH m AS (SELECT conv_id AS session_id, coalesce(text, '') AS content, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations),
r AS (SELECT session_id, place, content, CASE WHEN place <= (SELECT count(*) FROM m x WHERE x.session_id = m.session_id AND x.turn < 4) - 2 THEN 1 ELSE 2 END AS run FROM m
 WHERE place <= (SELECT count(*) FROM m x WHERE x.session_id = m.session_id) - 2)
SELECT session_id, min(place) AS from_place, max(place) AS upto_place, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars,
 array_to_string([left(x, 200) FOR x IN list(content ORDER BY place)[1:3]], chr(10)) AS summary FROM r GROUP BY session_id, run""")
def d05_condensation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions are condensed after their fourth turn and again at their end; the second run takes only what came after the first."""
    store = BatchStore(spark, _folder(spark, "condense"))
    rows = messages(spark, sf)
    for k, some in enumerate((rows.where("turn < 4"), rows)):
        store.write(k, {"log_rows": condense(some, store.read("log_rows", LOG), keep=2)})
    return store.read("log_rows", LOG).drop("batch")


#: Events of a user that lie no more than six hours apart are one session.
GAP, LATE = 6 * 3_600_000_000, 365 * 86_400_000_000


@query(f"""WITH o AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events),
s AS (SELECT *, sum(CASE WHEN since IS NULL OR since > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nth FROM o)
SELECT user_id AS key, min(us) AS start_at, max(us) AS end_at, count(*) AS n FROM s GROUP BY user_id, nth""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the replayed events, merged from batch to batch."""
    store = BatchStore(spark, _folder(spark, "sessions"))
    feed = replay.stream(spark, f"{sf}/events.parquet", 1).select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    run(feed, store, sessions.session_tables(GAP, LATE))
    return sessions.read_sessions(store).select("key", "start_at", "end_at", "n")
