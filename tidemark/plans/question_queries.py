"""Search for all questions of a table, by all signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import question_search as qs
from tidemark.operators import rendering, retrieval, trigram_index
from tidemark.plans.memory_queries import _BELIEF_SQL, _beliefs, _entities
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES_SQL, load, memories

#: The stated query set of a search: user turns of the conversations that 50 divides. A third asks for a window of time, a third for what is
#: newer, all for a scope, every second conversation for two tiers.
_QUESTIONS_SQL = """qu AS (SELECT conv_id * 1000 + turn AS question_id, text, 'src' || (conv_id // 50 % 20) AS scope_id,
 CASE WHEN (conv_id + turn // 2) % 3 < 2 THEN 1704067200 + conv_id * 60 + 7 END AS after, CASE WHEN (conv_id + turn // 2) % 3 = 0 THEN 1704067200 + conv_id * 60 + 9007 END AS before,
 CASE WHEN conv_id % 100 = 0 THEN ['impression', 'principle'] END AS tiers FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.col("conv_id") + F.floor(F.col("turn") / 2)) % 3
    start = 1704067200 + F.col("conv_id") * 60
    return load(spark, sf, "conversations").where("role = 'user' AND conv_id % 50 = 0").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text", F.concat(F.lit("src"), (F.floor(F.col("conv_id") / 50) % 20).cast("string")).alias("scope_id"),
        F.when(kind < 2, start + 7).alias("after"), F.when(kind == 0, start + 9007).alias("before"),
        F.when(F.col("conv_id") % 100 == 0, F.array(F.lit("impression"), F.lit("principle"))).alias("tiers"),
    )


_TOKENS_SQL = f"""WITH {MEMORIES_SQL}, {_QUESTIONS_SQL},
qt AS (SELECT question_id, token, count(*) AS times, length(token) >= 3 AS word FROM (SELECT question_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM qu) GROUP BY question_id, token),
tk AS (SELECT entry_id, created_at, regexp_extract_all(lower(content), '[a-z]+') AS t FROM mem), co AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tk),
po AS (SELECT entry_id, created_at, token, dl, count(*) AS tf FROM (SELECT entry_id, created_at, len(t) AS dl, unnest(t) AS token FROM tk) WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM po GROUP BY token),
me AS (SELECT question_id, entry_id, created_at, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS raw, count(*) FILTER (word) AS held
 FROM po JOIN df USING (token) JOIN qt USING (token), co GROUP BY question_id, entry_id, created_at)"""
_BM25_SQL = """bm AS (SELECT question_id, entry_id, 'bm25' AS signal, 0.9 * raw / best AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 6) DESC, entry_id) AS place, max(raw) OVER (PARTITION BY question_id) AS best FROM me) WHERE place <= 30 AND raw / best > 0.1)"""
_TEXT_SQL = """te AS (SELECT question_id, entry_id, 'semantic' AS signal, 1.0 - 0.5 * (place - 1) / least(50, n) AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, entry_id) AS place, count(*) OVER (PARTITION BY question_id) AS n
  FROM me JOIN (SELECT question_id, count(*) AS words FROM qt WHERE word GROUP BY question_id) USING (question_id) WHERE held = words) WHERE place <= 50)"""
_KEYWORD_SQL = """kw AS (SELECT question_id, entry_id, 'keyword' AS signal, max(1.0 - 0.3 * (place - 1) / least(20, n)) AS score FROM qt JOIN
 (SELECT token, entry_id, row_number() OVER (PARTITION BY token ORDER BY tf DESC, entry_id) AS place, count(*) OVER (PARTITION BY token) AS n FROM po) USING (token) WHERE word AND place <= 20 GROUP BY question_id, entry_id)"""
_ENTITY_SQL = """el AS (SELECT entry_id, decay, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{6,}'))) AS label FROM mem),
ql AS (SELECT question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS label FROM qu),
en AS (SELECT question_id, entry_id, 'entity' AS signal, 0.9 - 0.4 * (place - 1) / least(20, n) AS score FROM ql JOIN
 (SELECT *, row_number() OVER (PARTITION BY label ORDER BY decay DESC, entry_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM el) USING (label) WHERE place <= 20)"""
_TIME_SQL = """tm AS (SELECT question_id, entry_id, 'temporal' AS signal, CASE WHEN after IS NULL OR before IS NULL THEN 0.6 WHEN before > after THEN greatest(0.0, 1 - abs(created_at - (after + before) / 2) / (before - after)) ELSE 0.5 END AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, entry_id) AS place FROM qu JOIN mem ON created_at >= coalesce(after, created_at) AND created_at <= coalesce(before, created_at) AND (after IS NOT NULL OR before IS NOT NULL)) WHERE place <= 100)"""
_SCOPE_SQL = """so AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY decay DESC, touched_at DESC, entry_id) AS place FROM mem), sc AS (SELECT question_id, entry_id, 'scope_boost' AS signal, 0.3 AS score FROM qu JOIN so USING (scope_id) WHERE place <= 100)"""
_FUSED_SQL = f"""{_TOKENS_SQL}, {_BM25_SQL}, {_TEXT_SQL}, {_KEYWORD_SQL}, {_ENTITY_SQL}, {_TIME_SQL}, {_SCOPE_SQL},
si AS (SELECT question_id, entry_id, signal, max(score) AS s, CASE signal WHEN 'semantic' THEN 0.35 WHEN 'keyword' THEN 0.25 WHEN 'bm25' THEN 0.2 WHEN 'entity' THEN 0.2 WHEN 'temporal' THEN 0.1 ELSE 0.05 END AS w
 FROM (SELECT * FROM bm UNION ALL SELECT * FROM te UNION ALL SELECT * FROM kw UNION ALL SELECT * FROM en UNION ALL SELECT * FROM tm UNION ALL SELECT * FROM sc) GROUP BY ALL),
fu AS (SELECT question_id, entry_id, least(1.0, sum(w * s) / sum(w) * CASE WHEN count(*) >= 3 THEN 1.2 WHEN count(*) = 2 THEN 1.1 ELSE 1 END) AS score, count(*) AS n_signals FROM si GROUP BY question_id, entry_id)"""
_BONUS_SQL = f"""{_FUSED_SQL}, {_BELIEF_SQL.removeprefix('WITH ')}, su AS (SELECT memory_id AS entry_id, max(confidence) AS confidence FROM bl WHERE superseded_at IS NULL GROUP BY memory_id),
ra AS (SELECT question_id, entry_id, round(least(1.0, score + 0.1 * least(0.15, 0.01 * hits) + coalesce(0.1 * confidence, 0.0)), 6) AS score, n_signals
 FROM fu JOIN mem USING (entry_id) JOIN (SELECT question_id, tiers FROM qu) USING (question_id) LEFT JOIN su USING (entry_id) WHERE tiers IS NULL OR list_contains(tiers, tier)),
fo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) AS place, max(score) OVER (PARTITION BY question_id) AS most FROM ra) WHERE place <= 20)"""
_SEARCH_SQL = f"""{_BONUS_SQL}, led AS (SELECT question_id, entry_id // 2 AS entry_id, round(0.5 * max(score), 6) AS score FROM fo WHERE most > 0.4 AND place <= 5 AND score >= 0.3 GROUP BY question_id, entry_id // 2),
al AS (SELECT question_id, entry_id, score, n_signals, false AS expanded FROM fo UNION ALL SELECT question_id, entry_id, score, 0, true FROM led WHERE entry_id IN (SELECT entry_id FROM mem) AND (question_id, entry_id) NOT IN (SELECT (question_id, entry_id) FROM fo)),
re AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) AS place FROM al)"""


def _text(spark: SparkSession, sf: str) -> DataFrame:
    return qs.text_signals(qs.write_postings(memories(spark, sf)), qs.question_tokens(questions(spark, sf)))


@query(f"""{_TOKENS_SQL}, {_BM25_SQL} SELECT question_id, entry_id, round(score, 6) AS score FROM bm""")
def r12_bm25_of_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's best thirty entries by BM25."""
    return _text(spark, sf).where("signal = 'bm25'").select("question_id", "entry_id", F.round("score", 6).alias("score"))


@query(f"""{_TOKENS_SQL}, {_KEYWORD_SQL}, {_TEXT_SQL} SELECT question_id, entry_id, signal, round(score, 6) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM te)""")
def r11_keywords_of_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of most occurrences of a question's words, and the newest that hold all of them."""
    return _text(spark, sf).where("signal <> 'bm25'").select("question_id", "entry_id", "signal", F.round("score", 6).alias("score"))


@query(f"""WITH {MEMORIES_SQL}, {_QUESTIONS_SQL}, {_TIME_SQL}, {_ENTITY_SQL}, {_SCOPE_SQL} SELECT question_id, entry_id, signal, round(score, 6) AS score FROM (SELECT * FROM tm UNION ALL SELECT * FROM en UNION ALL SELECT * FROM sc)""")
def r13_signals_of_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities a question names, its window of time (one end may be open), its scope."""
    rows, asked = memories(spark, sf), questions(spark, sf)
    mentions = _entities(spark, sf).join(rows.select("entry_id", "decay"), "entry_id")
    signals = qs.time_signal(asked, rows).union(qs.entity_signal(asked, mentions)).union(qs.scope_signal(asked, rows))
    return signals.withColumn("score", F.round("score", 6))


@query(f"""{_SEARCH_SQL} SELECT question_id, entry_id, score, n_signals, expanded FROM re WHERE place <= 20""")
def r20_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search: six signals, fused (R16), bonuses (R17), tiers (R18), expansion (R19), for all questions at once."""
    rows, asked = memories(spark, sf), questions(spark, sf)
    mentions = _entities(spark, sf).join(rows.select("entry_id", "decay"), "entry_id")
    beliefs = _beliefs(spark, sf).where("superseded_at IS NULL").select(F.col("memory_id").alias("entry_id"), "confidence")
    links = rows.select("entry_id", F.floor(F.col("entry_id") / 2).alias("to_id"))
    return qs.search(qs.write_postings(rows), asked, rows, mentions, beliefs, links)


_RENDER_SQL = f"""{_SEARCH_SQL}, rp AS (SELECT question_id, entry_id, score, title, content, created_at, place, score >= 0.7 AND place <= 3 AS core FROM re JOIN mem USING (entry_id) WHERE place <= 20),
sg AS (SELECT *, CASE WHEN core THEN 'core' WHEN score >= 0.35 AND row_number() OVER (PARTITION BY question_id, core ORDER BY place) <= 5 THEN 'context' ELSE 'archive' END AS stage FROM rp),
nt AS (SELECT *, row_number() OVER (PARTITION BY question_id, stage ORDER BY place) AS nth FROM sg),
tx AS (SELECT question_id, count(*) FILTER (stage = 'core') AS n_core, count(*) FILTER (stage = 'context') AS n_context, count(*) FILTER (stage = 'archive') AS n_archive,
 coalesce('{rendering.SYSTEM_HEAD}' || chr(10) || string_agg(chr(10) || '记忆' || nth || ' (共振: ' || CAST(round_even(score * 100, 0) AS BIGINT) || '%): ' || content, chr(10) ORDER BY place) FILTER (stage = 'core'), '') AS system,
 CASE WHEN count(*) FILTER (stage = 'core') > 0 THEN '[相关记忆]' || chr(10) ELSE '' END || coalesce(string_agg('• ' || title || ': ' || left(content, CASE stage WHEN 'core' THEN 200 ELSE 150 END), chr(10) ORDER BY place) FILTER (stage <> 'archive'), '') AS context,
 coalesce('[历史参考]' || chr(10) || string_agg('· ' || title || ' (' || strftime(make_timestamp(created_at * 1000000), '%m-%d') || ')', chr(10) ORDER BY place) FILTER (stage = 'archive' AND nth <= 10), '') AS archive,
 (sum(length(content)) + count(*) - 1) // 2 AS baseline_tokens FROM nt GROUP BY question_id),
tk2 AS (SELECT *, (length(system) + length(context) + length(archive) + greatest(0, (system <> '')::INT + (context <> '')::INT + (archive <> '')::INT - 1)) // 2 AS tokens FROM tx)"""


@query(f"""{_RENDER_SQL} SELECT question_id, n_core, n_context, n_archive, system, context, archive, CAST(tokens AS BIGINT) AS tokens, CAST(baseline_tokens AS BIGINT) AS baseline_tokens,
 CASE WHEN baseline_tokens > 0 THEN greatest(0.0, round((1 - tokens::DOUBLE / baseline_tokens) * 100, 1)) ELSE 0.0 END AS saved FROM tk2""")
def r28_rendered(spark: SparkSession, sf: str) -> DataFrame:
    """The results of every question as the texts that go into its prompt."""
    return rendering.rendered(r20_search(spark, sf).select("question_id", "entry_id", "score"), memories(spark, sf))


# ---- trigrams ----

#: Queries: the first words of every item; every tenth is a sign and a short word alone, which fall back to the text as it is.
_QUERIES_SQL = r"""qu AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 = 7 THEN 'is.' ELSE left(text, 12) || ' AND (of)' END AS text FROM benchmark),
wo AS (SELECT DISTINCT query_id, lower(w) AS word FROM (SELECT query_id, unnest(string_split_regex(regexp_replace(text, '[*()\[\]+"%?'',.:-]', ' ', 'g'), '\s+')) AS w FROM qu) WHERE length(w) >= 3 AND upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR'))"""
_PHRASES_SQL = f"""WITH {MEMORIES_SQL}, {_QUERIES_SQL}, tx AS (SELECT entry_id, created_at, title, content, lower(title || chr(10) || content) AS body, greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0) AS len FROM mem),
av AS (SELECT count(*) AS n, avg(len) AS mean FROM tx), dw AS (SELECT word, length(word) AS l, len([k FOR k IN range(1, length(word)) IF left(word, k) = right(word, k)]) > 0 AS laps FROM (SELECT DISTINCT word FROM wo)),
he AS (SELECT word, l, laps, entry_id, len, body FROM dw JOIN tx ON contains(body, word)),
hi AS (SELECT word, entry_id, len, CASE WHEN laps THEN len([i FOR i IN range(1, length(body) - l + 2) IF substr(body, i, l) = word]) ELSE (length(body) - length(replace(body, word, ''))) // l END AS times FROM he),
fr AS (SELECT word, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM hi, av GROUP BY word, n)"""


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("item_id") % 10 == 7, "is.").otherwise(F.concat(F.left("text", F.lit(12)), F.lit(" AND (of)")))
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))


@query(f"{_PHRASES_SQL} SELECT word, entry_id, times FROM hi")
def r02_trigram_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that hold each word of the queries, found by their trigrams, and how often."""
    words = _queries(spark, sf).select(F.explode(F.array_distinct(retrieval.match_words_of(F.col("text")))).alias("word")).where("length(word) >= 3")
    return trigram_index.phrase_hits(trigram_index.write_index(memories(spark, sf)), words).select("word", "entry_id", F.col("times").cast("long").alias("times"))


@query(f"""{_PHRASES_SQL}, me AS (SELECT query_id, entry_id, round(sum(idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM wo JOIN hi USING (word) JOIN fr USING (word), av
 GROUP BY query_id, entry_id HAVING count(*) = (SELECT count(*) FROM wo w WHERE w.query_id = wo.query_id)),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place FROM me) WHERE place <= 20),
li AS (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, entry_id) AS place FROM qu JOIN tx ON contains(lower(content), lower(text)) OR contains(lower(title), lower(text)) WHERE query_id NOT IN (SELECT query_id FROM be))
SELECT query_id, entry_id, score, place FROM be UNION ALL SELECT query_id, entry_id, 0.0, place FROM li WHERE place <= 20""")
def r03_text_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best entries of every query by phrase rank; the query as it is where its words find nothing."""
    return trigram_index.ranked(trigram_index.write_index(memories(spark, sf)), _queries(spark, sf))
