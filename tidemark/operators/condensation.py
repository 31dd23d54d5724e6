"""Condensing the old messages of sessions and the tiers of memories, each row once: marks and links say what is condensed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut
from tidemark.operators.store import per_key

LOG = "session_id bigint, from_place bigint, upto_place bigint, n bigint, chars bigint, summary string"


def condense(messages: DataFrame, log: DataFrame, keep: int = 20, heads: int = 3) -> DataFrame:
    """New rows of the log (`LOG`) for ``messages(session_id, turn, role, content)``: what lies between a session's mark and its newest ``keep`` messages.

    The summary is the beginning of the first ``heads`` of them. The mark is the highest place in the log; places never change, as messages are only
    appended. Sessions with nothing new give no row, so a second run changes nothing. Null contents are empty.
    """
    order = Window.partitionBy("session_id").orderBy("turn", "role", "content")
    placed = messages.select("session_id", "turn", "role", F.coalesce("content", F.lit("")).alias("content")).withColumns(
        {"place": F.row_number().over(order).cast("long"), "total": F.count("*").over(Window.partitionBy("session_id"))}
    )
    marks = log.groupBy("session_id").agg(F.max("upto_place").alias("mark"))
    old = placed.join(marks, "session_id", "left").where((F.col("place") <= F.col("total") - keep) & (F.col("place") > F.coalesce("mark", F.lit(0))))
    head = F.when(F.col("place") - F.coalesce("mark", F.lit(0)) <= heads, F.struct("place", F.left("content", F.lit(200)).alias("head")))
    return old.groupBy("session_id").agg(
        F.min("place").alias("from_place"), F.max("place").alias("upto_place"), F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda h: h["head"]), "\n").alias("summary"),  # three at most a session
    )


PATTERNS = "made_id string, scope_id string, kind string, label string, title string, content string, tags array<string>, beliefs array<string>, n_beliefs bigint, n_sources bigint, run int"
PRINCIPLES = "made_id string, scope_id string, title string, content string, tags array<string>, labels array<string>, n_sources bigint, run int"
LINKS = "made_id string, source_id string, scope_id string, kind string, label string"
CLUSTER = ("scope_id", "kind", "label")
#: Levels of belief that count as confirmed.
SURE = ("confirmed", "bedrock")
#: A cluster with more than this share of the rows is hot; there are at most 1,000 of them.
HOT_SHARE, HOT_LEAST = 1000, 64
# The texts of what is condensed.
PATTERN_TITLE = "关于「%s」的行为模式"
PATTERN_TEXT = "从 %d 条关于 %s 的印象中，识别出以下规律:\n- 高频标签: %s\n- 已确认信念: %d 条\n- 最近一条印象: %s"
NO_TAGS = "无"
PRINCIPLE_TITLE = "行动原则（基于 %d 条已验证模式）"
PRINCIPLE_TEXT = "以下原则已经过 %d 条模式的交叉验证:\n- 涉及实体: %s\n- 关键标签: %s\n- 原则描述: 在此上下文中，上述模式已稳定重复出现，可作为后续决策的参考依据。"


def _made_id(run: int, *parts: Column) -> Column:
    return F.left(F.md5(F.concat_ws("\x1f", *parts, F.lit(str(run))).cast("binary")), F.lit(16))


def _of_large_groups(rows: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """``rows`` joined with ``groups(*keys, n, ...)``; hot groups, 1,000 at most, by a broadcast, so that no task gets one whole."""
    limit = max(HOT_LEAST, rows.count() // HOT_SHARE)
    hot, rest = groups.where(F.col("n") > limit), groups.where(F.col("n") <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(rest, keys))


def _most_frequent(rows: DataFrame, value: str, most: int) -> DataFrame:
    """``made_id`` and its ``most`` most frequent values, ties in the order of the values. Counted before they are ranked."""
    counts = rows.where(F.col(value).isNotNull()).groupBy("made_id", value).agg(F.count("*").alias("times"))
    first = per_key(counts, ["made_id"], most, F.desc("times"), value).groupBy("made_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("o"), value))).alias("v"))
    return first.select("made_id", F.transform("v", lambda x: x[value]).alias(f"{value}s"))


def distil(entries: DataFrame, labels: DataFrame, beliefs: DataFrame, links: DataFrame, run: int, least: int = 5) -> dict[str, DataFrame]:
    """Patterns (`PATTERNS`) of the impressions that share a scope and an entity, ``least`` or more of them, and a link (`LINKS`) to each of these.

    ``entries(entry_id, scope_id, tier, tags, content, created_at)``, ``labels(entry_id, kind, label)``, ``beliefs(entry_id, belief_id, content, confidence)`` that hold now.
    An impression that ``links`` ties to a cluster is not counted there again, so a rerun makes a pattern only of what came since. A pattern has its five most frequent
    tags, the first five of its confirmed beliefs, their number, and the beginning of its newest impression. Null scopes, kinds and contents are empty, null labels are none.
    """
    some = entries.where("tier = 'impression'").select("entry_id", F.coalesce("scope_id", F.lit("")).alias("scope_id"), "created_at", "tags")
    named = labels.where("label IS NOT NULL").select("entry_id", F.coalesce("kind", F.lit("")).alias("kind"), "label").distinct()
    taken = links.select(F.col("source_id").try_cast("bigint").alias("entry_id"), *CLUSTER).distinct()
    rows = cut(named.join(some, "entry_id").join(taken, ["entry_id", *CLUSTER], "left_anti"))
    groups = rows.groupBy(*CLUSTER).agg(F.count("*").alias("n"), F.max(F.struct("created_at", "entry_id"))["entry_id"].alias("newest")).where(F.col("n") >= least)
    groups = cut(groups.withColumn("made_id", _made_id(run, *(F.col(c) for c in CLUSTER))))
    held = cut(_of_large_groups(rows.select("entry_id", "tags", *CLUSTER), list(CLUSTER), groups.select("made_id", "n", *CLUSTER)))
    sure = beliefs.where(F.col("confidence").isin(*SURE)).select("entry_id", "belief_id", F.col("content").alias("belief"))
    said = held.select("made_id", "entry_id").join(sure, "entry_id")
    first = per_key(said, ["made_id"], 5, "entry_id", "belief_id").groupBy("made_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "belief_id", "belief"))).alias("b"))
    parts = (
        _most_frequent(held.select("made_id", F.explode("tags").alias("tag")), "tag", 5),
        said.groupBy("made_id").agg(F.count("*").alias("n_beliefs")),
        first.select("made_id", F.transform("b", lambda x: x["belief"]).alias("beliefs")),
        groups.select("made_id", F.col("newest").alias("entry_id")).join(entries.select("entry_id", F.left("content", F.lit(200)).alias("head")), "entry_id").groupBy("made_id").agg(F.max("head").alias("head")),
    )
    whole = reduce(lambda a, b: a.join(b, "made_id", "left"), parts, groups.select("made_id", "n", *CLUSTER)).fillna(0, ["n_beliefs"])
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    shown = F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(NO_TAGS)
    text = F.format_string(PATTERN_TEXT, "n", "label", shown, "n_beliefs", F.coalesce("head", F.lit("")))
    patterns = whole.select(
        "made_id", *CLUSTER, F.format_string(PATTERN_TITLE, "label").alias("title"), text.alias("content"), tags.alias("tags"),
        F.coalesce("beliefs", F.array().cast("array<string>")).alias("beliefs"), "n_beliefs", F.col("n").alias("n_sources"), F.lit(run).alias("run"),
    )
    return {"patterns": patterns, "links": held.select("made_id", F.col("entry_id").cast("string").alias("source_id"), *CLUSTER)}


def crystallise(patterns: DataFrame, links: DataFrame, run: int, least: int = 3) -> dict[str, DataFrame]:
    """A principle (`PRINCIPLES`) of each scope with ``least`` or more confirmed patterns that no principle rests on yet, and its links.

    ``patterns(made_id, scope_id, tags, labels, n_beliefs)``; one is confirmed if it has a confirmed belief. A principle has the three most frequent tags and the first
    ten entities, by name.
    """
    taken = links.select(F.col("source_id").alias("made_id"))
    rows = cut(patterns.where("n_beliefs > 0").join(taken, "made_id", "left_anti").select(F.col("made_id").alias("source_id"), F.coalesce("scope_id", F.lit("")).alias("scope_id"), "tags", "labels"))
    groups = cut(rows.groupBy("scope_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("made_id", _made_id(run, F.lit("principle"), F.col("scope_id"))))
    held = cut(_of_large_groups(rows, ["scope_id"], groups))
    names = per_key(held.select("made_id", F.explode("labels").alias("label")).distinct(), ["made_id"], 10, "label").groupBy("made_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    tags = _most_frequent(held.select("made_id", F.explode("tags").alias("tag")), "tag", 3)
    whole = groups.join(tags, "made_id", "left").join(names, "made_id", "left")
    none = F.array().cast("array<string>")
    whole = whole.withColumns({"tags": F.coalesce("tags", none), "labels": F.coalesce("labels", none)})
    text = F.format_string(PRINCIPLE_TEXT, "n", F.array_join("labels", ", "), F.array_join("tags", ", "))
    principles = whole.select("made_id", "scope_id", F.format_string(PRINCIPLE_TITLE, "n").alias("title"), text.alias("content"), "tags", "labels", F.col("n").alias("n_sources"), F.lit(run).alias("run"))
    return {"principles": principles, "links": held.select("made_id", "source_id", "scope_id", F.lit("").alias("kind"), F.lit("").alias("label"))}


def condense_tiers(entries: DataFrame, labels: DataFrame, beliefs: DataFrame, patterns: DataFrame, links: DataFrame, run: int) -> dict[str, DataFrame]:
    """Impressions to patterns to principles in one run: the new rows of `PATTERNS`, `PRINCIPLES` and `LINKS`, to be written together.

    ``patterns`` and ``links`` are what earlier runs wrote. Principles rest on patterns of this run, of earlier runs and on entries of the tier, each once.
    """
    made = distil(entries, labels, beliefs, links, run)
    new = cut(made["patterns"])
    condensed = lambda rows: rows.select("made_id", "scope_id", "tags", F.array("label").alias("labels"), "n_beliefs")
    sure = beliefs.where(F.col("confidence").isin(*SURE)).groupBy("entry_id").agg(F.count("*").alias("n_beliefs"))
    given = entries.where("tier = 'pattern'").select("entry_id", "scope_id", "tags").join(sure, "entry_id")
    named = labels.where("label IS NOT NULL").join(given.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.collect_set("label").alias("labels"))
    given = given.join(named, "entry_id", "left").select(F.col("entry_id").cast("string").alias("made_id"), "scope_id", "tags", "labels", "n_beliefs")
    over = crystallise(condensed(new).unionByName(condensed(patterns)).unionByName(given), links, run)
    return {"patterns": new, "principles": over["principles"], "links": made["links"].unionByName(over["links"])}
