"""Ranking: BM25 over a posting table, keyword hits, vector similarity, fusion and staging."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import search_tokens
from tidemark.operators.lineage import cut

K1, B = 1.5, 0.75
#: Weights of the signals.
SIGNAL_WEIGHTS = {"semantic": 0.35, "keyword": 0.25, "bm25": 0.20, "entity": 0.20, "temporal": 0.10}


def postings(docs: DataFrame, doc_id: str = "entry_id", text: str = "content") -> DataFrame:
    """``entry_id, token, tf, dl``: written once, it serves any number of queries."""
    tokens = docs.select(F.col(doc_id).alias("entry_id"), search_tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    return tokens.select("entry_id", "dl", F.explode("tokens").alias("token")).groupBy("entry_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_tokens(query: str) -> Counter:
    words = re.findall(r"[a-z]+", query.lower())
    han = "".join(re.findall(r"[一-鿿]", query))
    return Counter(words + list(han) + [han[i : i + 2] for i in range(len(han) - 1)])


def asked_postings(docs: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """``entry_id, token, tf, dl`` of the terms asked for, and one row ``n, mean`` of the corpus: one scan of the texts, whatever the
    number of terms and of signals that use them."""
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    tokens = docs.select("entry_id", search_tokens(F.col("content")).alias("tokens"))
    each = cut(tokens.select("entry_id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: F.array_contains(wanted, t)).alias("hits")))
    tf = each.select("entry_id", "dl", F.explode("hits").alias("token")).groupBy("entry_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return tf, each.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))


def bm25(docs: DataFrame, query: str, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``entry_id, score``, the best at 1; scores up to .01 go. ``found``: postings of more terms than the query's, made before."""
    terms = query_tokens(query)
    tf, corpus = found or asked_postings(docs, list(terms))
    tf = tf.where(F.col("token").isin(*terms))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    times = F.lit(1)
    for t, n in terms.items():
        if n > 1:
            times = F.when(F.col("token") == t, n).otherwise(times)
    # at most one row a query term, and one row of corpus figures
    scored = tf.join(F.broadcast(df), "token").join(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    total = scored.groupBy("entry_id").agg(F.sum(part).alias("raw"))
    best = total.agg(F.max("raw").alias("best"))
    return total.join(F.broadcast(best)).select("entry_id", (F.col("raw") / F.col("best")).alias("score")).where("score > 0.01")


def bm25_signal(docs: DataFrame, query: str, n: int = 30, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    best = bm25(docs, query, found).where("score > 0.1").orderBy(F.desc(F.round("score", 9)), "entry_id").limit(n)
    return best.select("entry_id", F.lit("bm25").alias("signal"), (0.9 * F.col("score")).alias("score"))


def keyword_signal(docs: DataFrame, words: list[str], n: int = 20, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """For each word the ``n`` rows with most occurrences: .8 falling to .5 by place, and .2 for containing it."""
    tf, _ = found or asked_postings(docs, words)
    hits = place_signal(tf.where(F.col("token").isin(*words)), "keyword", "token", 0.8, 0.3, n, F.desc("tf"), "entry_id")
    return hits.withColumn("score", F.col("score") + 0.2)


def fuse(signals: DataFrame, cap: float = 1.0) -> DataFrame:
    """Weighted mean over the signals a row has (the best of each), raised for rows that several agree on."""
    best = signals.groupBy("entry_id", "signal").agg(F.max("score").alias("score"))
    weight = F.lit(0.05)
    for name, w in SIGNAL_WEIGHTS.items():
        weight = F.when(F.col("signal") == name, w).otherwise(weight)
    out = best.groupBy("entry_id").agg((F.sum(weight * F.col("score")) / F.sum(weight)).alias("mean"), F.count("*").alias("n_signals"))
    boost = F.when(F.col("n_signals") >= 3, 1.2).when(F.col("n_signals") == 2, 1.1).otherwise(1.0)
    return out.select("entry_id", F.least(F.lit(cap), F.col("mean") * boost).alias("score"), "n_signals")


def recall(docs: DataFrame, query: str, n: int = 20) -> DataFrame:
    """Hybrid search: BM25 and keyword signals, fused, the best ``n``."""
    words = [w for w in dict.fromkeys(re.findall(r"[a-z]{3,}", query.lower()))]
    found = asked_postings(docs, [*dict.fromkeys([*query_tokens(query), *words])])
    signals = bm25_signal(docs, query, found=found)
    if words:
        signals = signals.union(keyword_signal(docs, words, found=found))
    return fuse(signals).select("entry_id", F.round("score", 6).alias("score"), "n_signals").orderBy(F.desc("score"), "entry_id").limit(n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_top(vectors: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """Cosine of every vector with the one query row, the best ``n``; vectors of length zero never match."""
    one = query.limit(1).select(F.col("embedding").alias("q"))
    cosine = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    live = dot(F.col("embedding"), F.col("embedding")) > 0
    return vectors.where(live).join(F.broadcast(one)).select("vec_id", F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(n)


def stage(ranked: DataFrame, core: int = 3, context: int = 5) -> DataFrame:
    """core (score >= .7, at most 3), context (>= .35, at most 5 of the rest), archive. For result lists, not corpora."""
    order = (F.desc("score"), F.asc("entry_id"))
    first = ranked.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("is_core", (F.col("score") >= 0.7) & (F.col("place") <= core))
    rest = F.row_number().over(Window.partitionBy("is_core").orderBy(*order))
    level = F.when(F.col("is_core"), "core").when((F.col("score") >= 0.35) & (rest <= context), "context").otherwise("archive")
    return first.withColumn("stage", level).drop("is_core")


#: Characters that a full-text query loses, and words that are no words of it.
_QUERY_SIGNS, _QUERY_WORDS = '*()[]-+"%', ("AND", "OR", "NOT", "NEAR")


def match_words(query: str) -> list[str]:
    """The words a full-text query asks for; signs between them separate, words below three letters count only when alone."""
    bare = "".join(" " if c in _QUERY_SIGNS + "?',.:" else c for c in query)
    words = [w for w in bare.split() if w.upper() not in _QUERY_WORDS]
    return [w.lower() for w in words if len(w) >= 3] or [w.lower() for w in words]


def match_words_of(query: Column) -> Column:
    """The words of a column of queries, as `match_words` takes them, short ones included."""
    signs = "".join(f"\\{c}" for c in _QUERY_SIGNS + "?',.:")
    words = F.filter(F.split(F.regexp_replace(query, f"[{signs}]", " "), r"\s+"), lambda w: (w != "") & ~F.upper(w).isin(*_QUERY_WORDS))
    return F.transform(words, F.lower)


def text_match(docs: DataFrame, query: str) -> DataFrame:
    """Rows whose title or content holds every word of the query, whatever its case."""
    text = F.lower(F.concat_ws("\n", "title", "content"))
    for word in match_words(query):
        docs = docs.where(F.contains(text, F.lit(word)))
    return docs


def place_signal(rows: DataFrame, name: str, by: str, base: float, span: float, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of every ``by``, as a signal that falls from ``base`` by ``span`` with their place."""
    window = Window.partitionBy(by)
    ranked = rows.withColumn("place", F.row_number().over(window.orderBy(*order)) - 1).where(F.col("place") < n)
    score = base - span * F.col("place") / F.count("*").over(window)
    return ranked.select("entry_id", F.lit(name).alias("signal"), score.alias("score"))


def intent_score(now: Column, half_life: float = 30.0) -> Column:
    """``score`` of a row after the bonus that ``intent`` gives it by ``memory_type, is_active, starts_at, ends_at`` (epoch seconds), at most 1.

    The bonus halves every ``half_life`` days since the start; without an intent (``any``) the score stays.
    """
    kind, active, start, end = F.col("memory_type"), F.col("is_active"), F.col("starts_at"), F.col("ends_at")
    ago, ahead, lasts = F.floor((now - start) / 86400), F.floor((start - now) / 86400), F.floor((F.coalesce(end, now) - start) / 86400)
    none = F.lit(0.0)
    bonus = (
        F.when(F.col("intent") == "current_state", F.when((kind == "state") & active, 0.25).when(kind == "preference", 0.15).when(~active, -0.2).otherwise(0.0))
        .when(F.col("intent") == "historical_range", F.when(kind == "event", 0.15).otherwise(0.0) + F.coalesce(0.05 * F.when(start.isNotNull(), F.least(ago / 30, F.lit(1.0))), none))
        .when(F.col("intent") == "upcoming", F.when((kind == "plan") & active, 0.3).otherwise(0.0) + F.when(start > now, 0.1 * F.greatest(1 - ahead / 14, none)).otherwise(0.0))
        .when(F.col("intent") == "duration", F.when((kind == "state") & start.isNotNull(), 0.1 * F.least(lasts / 365, F.lit(1.0))).otherwise(0.0))
        .when(F.col("intent") == "specific_date", F.when(start.isNotNull(), 0.1).otherwise(0.0))
        .otherwise(0.0)
    )
    faded = bonus * F.when(ago > 0, F.pow(F.lit(0.5), ago / half_life)).otherwise(1.0)
    return F.when(F.col("intent") == "any", F.col("score")).otherwise(F.least(F.lit(1.0), F.col("score") + faded))
