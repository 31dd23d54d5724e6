"""Duplicates, curation, entities, beliefs, states, healing and condensation of memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import INTENTS, MEMORY_TYPES, NEGATIONS, intent, memory_type, space_words, state_key, word_runs
from tidemark.operators import duplicates, graphs, question_search, store
from tidemark.operators.lineage import cut
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, MEMORIES_SQL, events, load, memories, messages

MEM, EV = f"WITH {MEMORIES_SQL}", f"WITH {EVENTS_SQL}"


def _case(column: str, cues: tuple[tuple[str, str], ...], other: str) -> str:
    """The SQL of a list of cues."""
    whens = " ".join(f"WHEN regexp_matches(lower({column}), '{cue.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, cue in cues)
    return f"CASE {whens} ELSE '{other}' END"


# ---- types, intents and states ----

TYPED_SQL = f"""{MEM}, ty AS (SELECT *, {_case('content', MEMORY_TYPES, 'event')} AS memory_type,
 scope_id || ':state:' || replace(left(content, 6), ' ', '') AS key FROM mem)"""


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    typed = memories(spark, sf).withColumn("memory_type", memory_type(F.col("content")))
    return typed.withColumn("key", state_key(F.col("scope_id"), F.col("content")))


@query(f"{TYPED_SQL} SELECT entry_id, memory_type FROM ty")
def t02_memory_type(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select("entry_id", "memory_type")


@query(f"SELECT conv_id AS session_id, turn, {_case('text', INTENTS, 'any')} AS intent, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL")
def t01_query_intent(spark: SparkSession, sf: str) -> DataFrame:
    asked = messages(spark, sf).where("role = 'user'")
    return asked.groupBy("session_id", "turn", intent(F.col("content")).alias("intent")).agg(F.count("*").alias("n"))


@query(f"{TYPED_SQL} SELECT entry_id, CASE WHEN memory_type = 'state' THEN key ELSE '' END AS state_key FROM ty")
def t03_state_key(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select("entry_id", F.when(F.col("memory_type") == "state", F.col("key")).otherwise("").alias("state_key"))


@query(f"{TYPED_SQL} SELECT memory_type, count(*) AS n, min(entry_id) AS first_id FROM ty GROUP BY memory_type")
def t04_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).groupBy("memory_type").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"))


@query(f"""{TYPED_SQL} SELECT entry_id, memory_type, CASE WHEN memory_type IN ('state', 'plan', 'event') THEN created_at END AS starts_at,
 CASE WHEN memory_type = 'event' THEN created_at END AS ends_at, memory_type <> 'event' AS is_active FROM ty""")
def t05_annotate(spark: SparkSession, sf: str) -> DataFrame:
    """States and plans begin when they are written and stay active; events begin and end then."""
    starts = F.when(F.col("memory_type").isin("state", "plan", "event"), F.col("created_at"))
    ends = F.when(F.col("memory_type") == "event", F.col("created_at"))
    return _typed(spark, sf).select("entry_id", "memory_type", starts.alias("starts_at"), ends.alias("ends_at"), (F.col("memory_type") != "event").alias("is_active"))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """What is said of a user's last kind of event is a state of that user: one row an event, the key is user and kind."""
    return events(spark, sf).select("event_id", F.concat_ws(":", "memory_id", F.lit("state"), "kind").alias("key"), "at", "k")


_STATES_SQL = f"""{EV}, st AS (SELECT event_id, memory_id || ':state:' || kind AS key, "at", k FROM ev)"""


@query(f"{_STATES_SQL} SELECT key, count(*) - 1 AS n_closed, max(\"at\") AS closed_at FROM st GROUP BY key HAVING count(*) > 1")
def t06_deactivate(spark: SparkSession, sf: str) -> DataFrame:
    """How many older states of a key a new one closes, and when."""
    return _states(spark, sf).groupBy("key").agg((F.count("*") - 1).alias("n_closed"), F.max("at").alias("closed_at")).where("n_closed > 0")


@query(f"""{_STATES_SQL} SELECT event_id, key, lead("at") OVER w IS NULL AS is_active, lead("at") OVER w AS ended_at FROM st WINDOW w AS (PARTITION BY key ORDER BY "at", event_id)""")
def t07_state_exclusivity(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of a key is active; every other ends when the next one begins."""
    ended = F.lead("at").over(Window.partitionBy("key").orderBy("at", "event_id"))
    return _states(spark, sf).select("event_id", "key", ended.isNull().alias("is_active"), ended.alias("ended_at"))


@query(f"""{_STATES_SQL} SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, event_id DESC) AS place FROM st QUALIFY place <= 3""")
def t09_state_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The last three states of a key, newest first."""
    return store.per_key(_states(spark, sf), ["key"], 3, F.desc("at"), F.desc("event_id"), rank="place").select("key", "event_id", "place")


@query(f"{MEM} SELECT entry_id, decay FROM mem WHERE decay BETWEEN 0 AND 0.3 ORDER BY decay, touched_at DESC, entry_id LIMIT 20")
def t13_neglected(spark: SparkSession, sf: str) -> DataFrame:
    weak = memories(spark, sf).where(F.col("decay").between(0, 0.3))
    return store.top(weak, 20, "decay", F.desc("touched_at"), "entry_id").select("entry_id", "decay")


@query(f"{MEM} SELECT scope_id, CASE WHEN touched_at >= (SELECT max(touched_at) FROM mem) - 14 * 86400 THEN 'dynamic' ELSE 'static' END AS freshness, count(*) AS n FROM mem GROUP BY ALL")
def t14_freshness(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    now = rows.agg(F.max("touched_at").alias("now"))  # one row
    fresh = F.when(F.col("touched_at") >= F.col("now") - 14 * 86400, "dynamic").otherwise("static")
    return rows.join(F.broadcast(now)).groupBy("scope_id", fresh.alias("freshness")).agg(F.count("*").alias("n"))


# ---- duplicates and curation ----

_TOKENS_SQL = f"{MEM}, tk AS (SELECT entry_id, tier, scope_id, content, list_distinct([x FOR x IN string_split_regex(lower(content), '[ \\t\\n\\r\\f\\v]+') IF x <> '']) AS t FROM mem WHERE length(content) >= 30)"
_JACCARD = "len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.char_length("content") >= 30).withColumn("tokens", space_words(F.col("content")))


@query(f"""{_TOKENS_SQL}, c AS (SELECT min(entry_id) AS id, list_sort(t) AS t FROM tk GROUP BY list_sort(t))
SELECT a.id AS a, b.id AS b, round({_JACCARD}, 6) AS jaccard FROM c a JOIN c b ON a.id < b.id AND least(len(a.t), len(b.t)) > 0.85 * greatest(len(a.t), len(b.t)) WHERE {_JACCARD} > 0.85""")
def j12_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of different word sets above .85; members of equal sets are in h03."""
    return duplicates.similar_sets(_tokens(spark, sf).select("entry_id", "tokens"), 0.85).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_CODED_SQL = f"{_TOKENS_SQL}, co AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY list_sort(t)) AS keeps, count(*) OVER (PARTITION BY list_sort(t)) AS n FROM tk)"


def _same_words(spark: SparkSession, sf: str) -> DataFrame:
    coded = cut(duplicates.set_classes(_tokens(spark, sf)).select("entry_id", "code"))  # token sets are made once, the codes met twice
    return coded.join(coded.groupBy("code").agg(F.min("entry_id").alias("keeps"), F.count("*").alias("n")), "code").select("entry_id", "keeps", "n")


@query(f"{_CODED_SQL} SELECT entry_id, keeps, n FROM co")
def h03_duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every row: the smallest id with the same words, and its size."""
    return _same_words(spark, sf)


#: Sets of runs of Latin letters or Han characters, as curation takes them; candidates are the thirty strongest of the scope and ten rows that hold all words of the title.
_RUNS_SQL = f"{MEM}, tk AS (SELECT *, list_distinct(regexp_extract_all(lower(content), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-z]+')) AS t FROM mem)"
_CANDIDATES_SQL = f"""{_RUNS_SQL}, st AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY decay DESC, touched_at DESC, entry_id) AS place FROM tk),
qw AS (SELECT entry_id AS new_id, unnest(list_distinct(regexp_extract_all(lower(left(title, 50)), '[a-z]{{3,}}'))) AS token FROM mem WHERE entry_id % 50 = 0),
po AS (SELECT entry_id, token, count(*) AS tf FROM (SELECT entry_id, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS token FROM mem) WHERE token IN (SELECT token FROM qw) GROUP BY ALL),
al AS (SELECT new_id, entry_id, sum(tf) AS tf FROM qw JOIN po USING (token) GROUP BY new_id, entry_id HAVING count(*) = (SELECT count(*) FROM qw w WHERE w.new_id = qw.new_id)),
fu AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY tf DESC, entry_id) AS place FROM al),
ca AS (SELECT q.entry_id AS new_id, p.entry_id FROM tk q JOIN st p ON p.scope_id = q.scope_id AND p.place <= 30 WHERE q.entry_id % 50 = 0 AND p.entry_id <> q.entry_id
 UNION SELECT new_id, entry_id FROM fu WHERE place <= 10 AND entry_id <> new_id)"""
#: The oracle's edit distance counts bytes, so each accented letter of the tables becomes one byte that no text holds.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "".join(chr(k) for k in range(14, 32)) + ":;<"
_START = lambda t: f"translate(left({t}.content, 500), '{_LETTERS}', '{_BYTES}')"
_DECIDED_SQL = f"""{_CANDIDATES_SQL}, sc AS (SELECT new_id, a.entry_id, round(1 - levenshtein({_START('a')}, {_START('b')}) / greatest(length(left(a.content, 500)), length(left(b.content, 500))), 6) AS s
 FROM ca JOIN tk a ON a.entry_id = ca.entry_id JOIN tk b ON b.entry_id = ca.new_id WHERE {_JACCARD} >= 0.5),
be AS (SELECT new_id, arg_max(entry_id, (s, -entry_id)) AS best_id, max(s) AS similarity FROM sc WHERE s >= 0.5 GROUP BY new_id),
de AS (SELECT i.new_id, best_id, similarity, CASE WHEN similarity > 0.85 THEN 'skip' WHEN similarity > 0.65 THEN 'merge' ELSE 'insert' END AS decision FROM (SELECT DISTINCT new_id FROM ca) i LEFT JOIN be USING (new_id))"""


def _candidates(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The stated query set of a search (ids that 50 divides) against all rows: by scope and by the words of the title."""
    titles = new.select(F.col("entry_id").alias("question_id"), F.left("title", F.lit(50)).alias("text"))
    text = question_search.holding_all(question_search.write_postings(rows), question_search.question_tokens(titles), 10).where("question_id <> entry_id")
    return duplicates.scope_candidates(rows, new, 30).union(text.select(F.col("question_id").alias("new_id"), "entry_id")).distinct()


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    near = cut(_candidates(rows, rows.where("entry_id % 50 = 0")))
    return duplicates.decide(rows.withColumn("tokens", word_runs(F.col("content"))), near)


@query(f"{_CANDIDATES_SQL} SELECT new_id, entry_id FROM ca")
def j15_dedup_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = memories(spark, sf)
    return _candidates(rows, rows.where("entry_id % 50 = 0"))


@query(f"{_DECIDED_SQL} SELECT * FROM de")
def c01_dedup_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf)


@query(f"{_DECIDED_SQL} SELECT decision, count(*) AS n FROM de GROUP BY decision")
def c03_smart_insert(spark: SparkSession, sf: str) -> DataFrame:
    """How many new memories go in, join another or stay out."""
    return _decided(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


_WRITE_SQL = f"""{MEM}, tk AS (SELECT *, list_distinct([x FOR x IN string_split_regex(lower(content), '[ \\t\\n\\r\\f\\v]+') IF x <> '']) AS t FROM mem),
re AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY touched_at DESC, entry_id) AS place FROM tk WHERE length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 20),
sc AS (SELECT b.entry_id AS new_id, a.entry_id, {_JACCARD} AS s FROM tk b JOIN re a ON a.tier = b.tier AND a.place <= 500 AND a.entry_id <> b.entry_id WHERE b.entry_id % 50 = 0 AND least(len(a.t), len(b.t)) > 0.7 * greatest(len(a.t), len(b.t)))"""


@query(f"{_WRITE_SQL} SELECT new_id, entry_id, CASE WHEN s > 0.85 THEN 'warning' ELSE 'info' END AS level FROM sc WHERE s > 0.7")
def j14_write_check(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set (ids that 50 divides), as if written now, against the 500 rows of its tier touched last: above .85 a warning, above .7 a note."""
    rows = memories(spark, sf).withColumn("tokens", space_words(F.col("content")))
    return duplicates.recent_overlaps(rows, rows.where("entry_id % 50 = 0")).select("new_id", "entry_id", F.when(F.col("overlap") > 0.85, "warning").otherwise("info").alias("level"))


# ---- contradictions and healing ----

_PAIRS_SQL = ", ".join(f"('{p}', '{n}')" for p, n in NEGATIONS)
_FLAGS_SQL = f"""{MEM}, ng AS (SELECT * FROM (VALUES {_PAIRS_SQL}) v(pos, neg)),
ba AS (SELECT entry_id, tier, lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS content FROM mem),
fl AS (SELECT entry_id, tier, pos || '/' || neg AS pair, contains(content, pos) AS p, contains(content, neg) AS n FROM ba, ng WHERE length(content) >= 30 AND (contains(content, pos) OR contains(content, neg)))"""


@query(f"""{_FLAGS_SQL}, su AS (SELECT tier, pair, count(*) FILTER (p AND NOT n) AS x, count(*) FILTER (n AND NOT p) AS y, count(*) FILTER (p AND n) AS z, min(entry_id) FILTER (p) AS first_pos, min(entry_id) FILTER (n) AS first_neg FROM fl GROUP BY ALL)
SELECT tier, pair, CAST(x * y + x * z + y * z + z * (z - 1) // 2 AS BIGINT) AS n_pairs, first_pos, first_neg FROM su WHERE x * y + x * z + y * z + z * (z - 1) // 2 > 0""")
def j13_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of a tier contradict each other on each expression; the pairs themselves grow with the square and are never made."""
    return duplicates.contradiction_counts(memories(spark, sf))


@query(f"""{MEM}, sh AS (SELECT l.conv_id, l.turn, lower(l.text) AS a, lower(r.text) AS b FROM conversations l JOIN conversations r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1),
ng AS (SELECT * FROM (VALUES {_PAIRS_SQL}) v(pos, neg))
SELECT conv_id AS session_id, turn, pos || '/' || neg AS pair, count(*) AS n FROM sh, ng WHERE (contains(a, pos) AND contains(b, neg)) OR (contains(a, neg) AND contains(b, pos)) GROUP BY ALL""")
def x22_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring messages of a session that contradict each other, by expression."""
    rows = messages(spark, sf).withColumn("content", duplicates.bare(F.col("content")))
    after = rows.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("after"))
    holds = lambda c, x: F.contains(c, F.lit(x))
    hits = [F.when((holds("content", p) & holds("after", n)) | (holds("content", n) & holds("after", p)), F.lit(f"{p}/{n}")) for p, n in NEGATIONS]
    pairs = rows.join(after, ["session_id", "turn"]).select("session_id", "turn", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("pair"))
    return pairs.groupBy("session_id", "turn", "pair").agg(F.count("*").alias("n"))


@query(f"""{_STATES_SQL}, la AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, event_id DESC) AS back FROM st)
SELECT key, count(DISTINCT k) AS n_values FROM la WHERE back <= 2 GROUP BY key HAVING count(DISTINCT k) > 1""")
def h05_conflicting_state(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose active states (here the last two) say different things."""
    active = store.per_key(_states(spark, sf), ["key"], 2, F.desc("at"), F.desc("event_id"))
    return active.groupBy("key").agg(F.countDistinct("k").alias("n_values")).where("n_values > 1")


_ISSUES_SQL = f"""{_CODED_SQL}, {_FLAGS_SQL.removeprefix(MEM + ', ')}, {_STATES_SQL.removeprefix('WITH ')},
la AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, event_id DESC) AS back FROM st),
mi AS (SELECT m.entry_id, m.entry_id + m.hits * 1000 AS ref FROM mem m WHERE hits > 0),
iss AS (SELECT 'duplicate_content' AS kind, entry_id AS a, keeps AS b, 'warning' AS level FROM co WHERE entry_id <> keeps
 UNION ALL SELECT 'temporal_anomaly', entry_id, CAST(NULL AS BIGINT), CASE WHEN created_at - touched_at < 3600 THEN 'info' ELSE 'warning' END FROM mem WHERE touched_at < created_at
 UNION ALL SELECT 'missing_reference', entry_id, ref, 'warning' FROM mi WHERE ref NOT IN (SELECT entry_id FROM mem)
 UNION ALL SELECT 'contradictory_belief', min(entry_id) FILTER (p), min(entry_id) FILTER (n), 'warning' FROM fl GROUP BY tier, pair HAVING count(*) FILTER (p) > 0 AND count(*) FILTER (n) > 0 AND count(*) > 1
 UNION ALL SELECT 'conflicting_state', max(event_id) FILTER (back = 1), max(event_id) FILTER (back = 2), 'warning' FROM la WHERE back <= 2 GROUP BY key HAVING count(DISTINCT k) > 1)"""


def _issues(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """``kind, a, b, level`` of the detectors named, of all five if none is: the others are never planned."""
    rows = memories(spark, sf)
    issue = lambda kind, df, a, b, level="warning": df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast("long").alias("b"), (F.lit(level) if isinstance(level, str) else level).alias("level"))

    def missing() -> DataFrame:
        refs = rows.where("hits > 0").select("entry_id", (F.col("entry_id") + F.col("hits") * 1000).alias("ref"))
        return issue("missing_reference", refs.join(rows.select(F.col("entry_id").alias("ref")), "ref", "left_anti"), "entry_id", F.col("ref"))

    def states() -> DataFrame:
        last = store.per_key(_states(spark, sf), ["key"], 2, F.desc("at"), F.desc("event_id"))
        at = lambda k: F.max(F.when(F.col("rn") == k, F.col("event_id")))
        return issue("conflicting_state", last.groupBy("key").agg(F.countDistinct("k").alias("n"), at(1).alias("a"), at(2).alias("b")).where("n > 1"), "a", F.col("b"))

    early = F.when(F.col("created_at") - F.col("touched_at") < 3600, "info").otherwise("warning")
    detectors = {
        "duplicate_content": lambda: issue("duplicate_content", _same_words(spark, sf).where("entry_id <> keeps"), "entry_id", F.col("keeps")),
        "temporal_anomaly": lambda: issue("temporal_anomaly", rows.where("touched_at < created_at"), "entry_id", F.lit(None), early),
        "missing_reference": missing,
        # pairs grow with the square of a group: one issue for each expression of a tier, named by the first rows that hold it and its negation
        "contradictory_belief": lambda: issue("contradictory_belief", duplicates.contradiction_counts(rows), "first_pos", F.col("first_neg")),
        "conflicting_state": states,
    }
    found = [make() for kind, make in detectors.items() if not kinds or kind in kinds]
    return reduce(DataFrame.union, found)


@query(f"{_ISSUES_SQL} SELECT kind, level, count(*) AS n, min(sha1(kind || ':' || a || ':' || coalesce(CAST(b AS VARCHAR), ''))) AS first_issue FROM iss GROUP BY ALL")
def h02_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors at once; an issue is named by what it is about, so scans repeat themselves."""
    name = F.sha1(F.concat_ws(":", "kind", F.col("a").cast("string"), F.coalesce(F.col("b").cast("string"), F.lit(""))))
    return _issues(spark, sf).groupBy("kind", "level").agg(F.count("*").alias("n"), F.min(name).alias("first_issue"))


@query(f"{_ISSUES_SQL} SELECT a AS entry_id, b AS ref FROM iss WHERE kind = 'missing_reference'")
def h07_missing_reference(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf, "missing_reference").select(F.col("a").alias("entry_id"), F.col("b").alias("ref"))


@query(f"{_ISSUES_SQL} SELECT kind, a, b FROM iss WHERE level = 'warning' AND NOT (kind = 'missing_reference' AND a % 2 = 0)")
def h09_open_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings that nobody dismissed: optional conditions are joined by and. Dismissed here: missing references of even ids."""
    wanted = {"level": "warning", "kind": None}
    rows = _issues(spark, sf)
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    dismissed = _issues(spark, sf, "missing_reference").where("a % 2 = 0").select("kind", "a")
    return rows.join(dismissed, ["kind", "a"], "left_anti").select("kind", "a", "b")


@query(f"""{MEM} SELECT entry_id, CASE tag WHEN 'en' THEN 'impressions' WHEN 'de' THEN 'patterns' WHEN 'fr' THEN 'principles' ELSE 'impressions' END AS place
 FROM mem WHERE hits >= 10 AND decay >= 0.5 AND scope_id IS NOT NULL""")
def f06_optional_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions that are given are joined by and; H10: other names of tiers, anything unknown is an impression."""
    given = {"hits": (10, None), "decay": (0.5, None), "created_at": (None, None)}
    rows = memories(spark, sf).where("scope_id IS NOT NULL")
    for column, (least, most) in given.items():
        rows = rows if least is None else rows.where(F.col(column) >= least)
        rows = rows if most is None else rows.where(F.col(column) <= most)
    alias = F.create_map(*(F.lit(x) for x in ("en", "impressions", "de", "patterns", "fr", "principles")))
    return rows.select("entry_id", F.coalesce(F.element_at(alias, F.col("tag")), F.lit("impressions")).alias("place"))


# ---- entities ----

#: Entities of a memory: the words of six letters or more in its title.
_ENTITY_SQL = f"{MEM}, en AS (SELECT entry_id, tier, created_at, tag, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{{6,}}'))) AS label FROM mem)"


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{6,})"), F.lit(1)))
    return memories(spark, sf).select("entry_id", "tier", "created_at", "tag", F.explode(words).alias("label"))


def _met(spark: SparkSession, sf: str) -> DataFrame:
    """Entity pairs of each memory: the entities of a title are few, so pairs are made inside its row."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{6,})"), F.lit(1))))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return memories(spark, sf).select("entry_id", "tier", "created_at", words.alias("w")).select("entry_id", "tier", "created_at", F.explode(pairs).alias("p")).select("entry_id", "tier", "created_at", "p.*")


_MET_SQL = f"{_ENTITY_SQL}, me AS (SELECT x.entry_id, x.tier, x.created_at, x.label AS a, y.label AS b FROM en x JOIN en y ON x.entry_id = y.entry_id AND x.label < y.label)"


@query(f"{_MET_SQL} SELECT entry_id, a, b FROM me")
def j16_entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _met(spark, sf).select("entry_id", "a", "b")


@query(f"{_MET_SQL} SELECT a, b, count(*) AS weight, max(created_at) AS last_seen FROM me GROUP BY a, b")
def a03_cooccurrence_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _met(spark, sf).groupBy("a", "b").agg(F.count("*").alias("weight"), F.max("created_at").alias("last_seen"))


@query(f"{_ENTITY_SQL} SELECT DISTINCT entry_id FROM en WHERE label ILIKE '%tion%'")
def f04_entity_like(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf).where(F.col("label").ilike("%tion%")).select("entry_id").distinct()


@query(f"{_ENTITY_SQL} SELECT label, count(*) AS n, min(entry_id) AS first_id, max(entry_id) AS last_id FROM en GROUP BY label")
def g04_link_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Label to memories, as the size and the ends of the list."""
    return _entities(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"), F.max("entry_id").alias("last_id"))


@query(f"{_ENTITY_SQL} SELECT label, count(*) AS n, min(tag) AS etype FROM en GROUP BY label ORDER BY n DESC, label LIMIT 20")
def a15_top_entities(spark: SparkSession, sf: str) -> DataFrame:
    return store.top(_entities(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.min("tag").alias("etype")), 20, F.desc("n"), "label")


@query(f"{_ENTITY_SQL}, fi AS (SELECT label, min(entry_id) AS hub, count(*) AS n FROM en GROUP BY label) SELECT DISTINCT hub AS a, entry_id AS b FROM en JOIN fi USING (label) WHERE entry_id <> hub")
def j17_memory_links(spark: SparkSession, sf: str) -> DataFrame:
    """Memories that share an entity, each linked to the first of them: pairs of a common entity would grow with its square."""
    rows = _entities(spark, sf)
    hub = rows.groupBy("label").agg(F.min("entry_id").alias("a"))
    return rows.join(hub, "label").where("entry_id <> a").select("a", F.col("entry_id").alias("b")).distinct()


@query(f"""{_MET_SQL}, q AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS label FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
bo AS (SELECT entry_id, least(1.0, decay + 0.08 * count(DISTINCT label)) AS score FROM en JOIN (SELECT DISTINCT label FROM q) USING (label) JOIN mem USING (entry_id) GROUP BY entry_id, decay)
SELECT entry_id, round(score, 6) AS score FROM bo""")
def g05_entity_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity of a question (here the first passage) that a memory has adds .08 to its score, up to 1."""
    first = store.top(load(spark, sf, "benchmark"), 1, "item_id")
    asked = first.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)))).alias("label"))
    hits = _entities(spark, sf).join(asked, "label", "left_semi").groupBy("entry_id").agg(F.count("*").alias("n"))
    return memories(spark, sf).join(hits, "entry_id").select("entry_id", F.round(F.least(F.lit(1.0), F.col("decay") + 0.08 * F.col("n")), 6).alias("score"))


_RELATED_SQL = f"""{_MET_SQL}, se AS (SELECT label FROM en GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
bo AS (SELECT CASE WHEN a = label THEN b ELSE a END AS other, tier FROM me, se WHERE a = label OR b = label),
su AS (SELECT other, count(*) FILTER (tier <> 'impression') AS explicit, count(*) AS cooc FROM bo GROUP BY other)"""


@query(f"{_RELATED_SQL} SELECT other, round(0.6 * explicit + 0.4 * cooc / (SELECT max(cooc) FROM su), 6) AS score FROM su WHERE 0.6 * explicit + 0.4 * cooc / (SELECT max(cooc) FROM su) >= 0.1")
def a09_related_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities around the most frequent one: explicit edges (of patterns and principles) count .6, meetings up to .4."""
    seed = store.top(_entities(spark, sf).groupBy("label").agg(F.count("*").alias("n")), 1, F.desc("n"), "label").select("label")
    touch = _met(spark, sf).join(F.broadcast(seed), (F.col("a") == F.col("label")) | (F.col("b") == F.col("label")))
    other = F.when(F.col("a") == F.col("label"), F.col("b")).otherwise(F.col("a"))
    sums = touch.groupBy(other.alias("other")).agg(F.count_if(F.col("tier") != "impression").alias("explicit"), F.count("*").alias("cooc"))
    score = 0.6 * F.col("explicit") + 0.4 * F.col("cooc") / F.col("most")
    most = sums.agg(F.max("cooc").alias("most"))  # one row
    return sums.join(F.broadcast(most)).where(score >= 0.1).select("other", F.round(score, 6).alias("score"))


@query(f"""{_ENTITY_SQL}, cl AS (SELECT tag || ':' || label AS cluster, entry_id, decay FROM en JOIN mem USING (entry_id, tag) WHERE mem.tier = 'impression' QUALIFY count(*) OVER (PARTITION BY tag, label) >= 5)
SELECT cluster, count(*) AS n, round(avg(decay), 6) AS mean_decay FROM cl GROUP BY cluster""")
def a23_entity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Impressions by type and entity, five or more."""
    rows = _entities(spark, sf).where("tier = 'impression'").join(memories(spark, sf).select("entry_id", "decay"), "entry_id")
    grouped = rows.groupBy(F.concat_ws(":", "tag", "label").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("decay"), 6).alias("mean_decay"))
    return grouped.where("n >= 5")


_PATTERN_SQL = f"""{_ENTITY_SQL}, cl AS (SELECT tag || ':' || label AS cluster, label, entry_id FROM en WHERE tier = 'impression' QUALIFY count(*) OVER (PARTITION BY tag, label) >= 5),
pa AS (SELECT cluster, min(label) AS label, count(*) AS n, list_sort(list(entry_id))[1:5] AS sources FROM cl GROUP BY cluster)"""


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entities(spark, sf).where("tier = 'impression'").withColumn("cluster", F.concat_ws(":", "tag", "label"))
    first = store.per_key(rows, ["cluster"], 5, "entry_id").groupBy("cluster").agg(F.array_sort(F.collect_list("entry_id")).alias("sources"))
    return rows.groupBy("cluster").agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n >= 5").join(first, "cluster")


@query(f"{_PATTERN_SQL} SELECT cluster, 'Pattern of ' || label || ' in ' || n || ' impressions' AS title, array_to_string(sources, ',') AS sources FROM pa")
def d01_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern row for every cluster of impressions: its title and its first five sources."""
    return _patterns(spark, sf).select("cluster", F.format_string("Pattern of %s in %d impressions", "label", "n").alias("title"), F.array_join("sources", ",").alias("sources"))


@query(f"{_PATTERN_SQL}, pr AS (SELECT split_part(cluster, ':', 1) AS tag, count(*) AS n, list_sort(list(label))[1:10] AS labels FROM pa GROUP BY 1 HAVING count(*) >= 3) SELECT tag, n, array_to_string(labels, ',') AS labels FROM pr")
def d02_principles(spark: SparkSession, sf: str) -> DataFrame:
    """Three patterns of a tag or more make a principle of their first ten entities."""
    rows = _patterns(spark, sf).select(F.split_part("cluster", F.lit(":"), F.lit(1)).alias("tag"), "label")
    first = store.per_key(rows, ["tag"], 10, "label").groupBy("tag").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return rows.groupBy("tag").agg(F.count("*").alias("n")).where("n >= 3").join(first, "tag").select("tag", "n", "labels")


@query(f"{_MET_SQL}, w AS (SELECT a, b, count(*) AS weight FROM me GROUP BY a, b) SELECT a AS node, count(*) AS n, array_to_string(list_sort(list(b))[1:3], ', ') AS first_names FROM w GROUP BY a")
def g12_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What an entity is linked to: the number and the first three names."""
    edges = a03_cooccurrence_weights(spark, sf)
    first = store.per_key(edges, ["a"], 3, "b").groupBy("a").agg(F.array_join(F.array_sort(F.collect_list("b")), ", ").alias("first_names"))
    return edges.groupBy("a").agg(F.count("*").alias("n")).join(first, "a").select(F.col("a").alias("node"), "n", "first_names")


@query(f"{_MET_SQL}, w AS (SELECT a, b, count(*) AS weight FROM me GROUP BY a, b) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT a AS node, weight FROM w UNION ALL SELECT b, weight FROM w) GROUP BY node")
def g13_entity_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.degrees(a03_cooccurrence_weights(spark, sf)).select("node", "degree", F.col("weight").cast("long").alias("weight"))


# ---- beliefs ----

_BELIEF_SQL = f"""{EV}, bl AS (SELECT memory_id, event_id AS belief_id, kind AS content, k / 100.0 AS confidence, "at" AS adopted_at, lead("at") OVER (PARTITION BY memory_id, kind ORDER BY "at", event_id) AS superseded_at FROM ev)"""


def _beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as beliefs: each holds until the next one of its kind."""
    after = F.lead("at").over(Window.partitionBy("memory_id", "kind").orderBy("at", "event_id"))
    return events(spark, sf).select("memory_id", F.col("event_id").alias("belief_id"), F.col("kind").alias("content"), (F.col("k") / 100).alias("confidence"), F.col("at").alias("adopted_at"), after.alias("superseded_at"))


@query(f"{_BELIEF_SQL} SELECT memory_id, count(*) AS n_active, round(max(confidence), 6) AS best FROM bl WHERE superseded_at IS NULL GROUP BY memory_id")
def f13_active_beliefs(spark: SparkSession, sf: str) -> DataFrame:
    return _beliefs(spark, sf).where("superseded_at IS NULL").groupBy("memory_id").agg(F.count("*").alias("n_active"), F.round(F.max("confidence"), 6).alias("best"))


@query(f"""{_BELIEF_SQL}, ol AS (SELECT memory_id, arg_min(belief_id, (adopted_at, belief_id)) AS old_id FROM bl GROUP BY memory_id)
SELECT memory_id, belief_id, CASE WHEN belief_id = old_id THEN belief_id || '_rev1' END AS superseded_by FROM bl JOIN ol USING (memory_id)
UNION ALL SELECT memory_id, -old_id, NULL FROM ol""")
def b01_revise_belief(spark: SparkSession, sf: str) -> DataFrame:
    """The first belief of every memory is revised: it is marked, and a tentative one (here with the negative id) is added."""
    rows = _beliefs(spark, sf).select("memory_id", "belief_id", "adopted_at")
    old = rows.groupBy("memory_id").agg(F.min(F.struct("adopted_at", "belief_id")).alias("f")).select("memory_id", F.col("f.belief_id").alias("old_id"))
    marked = rows.join(old, "memory_id").select("memory_id", "belief_id", F.when(F.col("belief_id") == F.col("old_id"), F.concat(F.col("belief_id").cast("string"), F.lit("_rev1"))).alias("superseded_by"))
    return marked.union(old.select("memory_id", -F.col("old_id"), F.lit(None).cast("string")))


@query(f"""{_BELIEF_SQL} SELECT memory_id, content, arg_max(belief_id, (adopted_at, belief_id)) AS belief_id, count(*) AS n_logged FROM bl GROUP BY ALL""")
def b02_belief_log(spark: SparkSession, sf: str) -> DataFrame:
    """The last logged row of every belief wins."""
    return _beliefs(spark, sf).groupBy("memory_id", "content").agg(F.max_by("belief_id", F.struct("adopted_at", "belief_id")).alias("belief_id"), F.count("*").alias("n_logged"))


@query(f"""{_BELIEF_SQL} SELECT memory_id, belief_id, content, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY memory_id ORDER BY adopted_at, belief_id) AS place, superseded_at IS NULL AS is_current FROM bl""")
def w09_belief_chain(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy("adopted_at", "belief_id"))
    return _beliefs(spark, sf).select("memory_id", "belief_id", "content", F.round("confidence", 6).alias("confidence"), place.alias("place"), F.col("superseded_at").isNull().alias("is_current"))


@query(f"""{_BELIEF_SQL} SELECT memory_id, count(*) AS n, count(superseded_at) AS n_revisions, coalesce(arg_min(content, (adopted_at, belief_id)) FILTER (superseded_at IS NULL), arg_max(content, (adopted_at, belief_id))) AS shown FROM bl GROUP BY memory_id""")
def a18_belief_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Beliefs of a memory, how many were revised, and the first that still holds."""
    order = F.struct("adopted_at", "belief_id")
    current = F.min(F.when(F.col("superseded_at").isNull(), F.struct(order.alias("o"), "content")))
    return _beliefs(spark, sf).groupBy("memory_id").agg(F.count("*").alias("n"), F.count("superseded_at").alias("n_revisions"), F.coalesce(current["content"], F.max_by("content", order)).alias("shown"))


# ---- condensation and lists ----


@query("""WITH m AS (SELECT conv_id, turn, '[' || role || ']: ' || left(text, 200) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations),
r AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM m)
SELECT conv_id AS session_id, string_agg(line, chr(10) ORDER BY place) AS summary FROM r WHERE upto <= 500 GROUP BY conv_id""")
def d06_truncation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first lines of a session, each cut to 200 characters, while they fit into 500."""
    lines = messages(spark, sf).withColumn("line", F.concat(F.lit("["), "role", F.lit("]: "), F.left("content", F.lit(200))))
    order = Window.partitionBy("session_id").orderBy("turn", "role", "content")
    running = lines.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum(F.char_length("line")).over(Window.partitionBy("session_id").orderBy("place")))
    kept = running.where("upto <= 500").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return kept.select("session_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("summary"))


@query("""SELECT conv_id AS session_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations QUALIFY used <= 4000""")
def w06_char_budget(spark: SparkSession, sf: str) -> DataFrame:
    used = F.sum(F.char_length("content")).over(Window.partitionBy("session_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, 0))
    return messages(spark, sf).select("session_id", "turn", used.alias("used")).where("used <= 4000")


@query(f"""{MEM}, r AS (SELECT entry_id, tier, decay, row_number() OVER (PARTITION BY tier ORDER BY decay DESC, entry_id) AS rn FROM mem) SELECT entry_id, tier FROM r WHERE rn <= 10 ORDER BY decay DESC, entry_id LIMIT 20""")
def k03_tier_then_global(spark: SparkSession, sf: str) -> DataFrame:
    """The ten strongest of each tier, then the twenty strongest of those."""
    return store.top(store.per_key(memories(spark, sf), ["tier"], 10, F.desc("decay"), "entry_id"), 20, F.desc("decay"), "entry_id").select("entry_id", "tier")


@query(f"{MEM}, o AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY decay DESC, entry_id) AS place, decay >= 0.7 AS strong FROM mem), c AS (SELECT *, strong AND place <= 3 AS core FROM o)\n"
       " SELECT entry_id, CASE WHEN core THEN 'core' WHEN decay >= 0.35 AND row_number() OVER (PARTITION BY scope_id, core ORDER BY decay DESC, entry_id) <= 5 THEN 'context' ELSE 'archive' END AS stage FROM c")  # fmt: skip
def w10_tiered_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Of each scope the three strongest from .7 on are core, the next five from .35 on context, the rest archive."""
    order = (F.desc("decay"), F.asc("entry_id"))
    rows = memories(spark, sf).select("entry_id", "scope_id", "decay")
    first = store.per_key(rows, ["scope_id"], 8, *order, rank="place").withColumn("core", (F.col("decay") >= 0.7) & (F.col("place") <= 3))  # core and context are among eight
    rest = F.row_number().over(Window.partitionBy("scope_id", "core").orderBy(*order))
    stage = F.when(F.col("core"), "core").when((F.col("decay") >= 0.35) & (rest <= 5), "context").otherwise("archive")
    return rows.select("entry_id").join(first.select("entry_id", stage.alias("stage")), "entry_id", "left").fillna("archive", ["stage"])
