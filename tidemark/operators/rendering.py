"""Search results as text for a prompt: staged by score, a line a memory, one text of each kind a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE, CONTEXT, ARCHIVE = 3, 5, 10
CORE_SCORE, CONTEXT_SCORE = 0.7, 0.35
CHARS_PER_TOKEN = 0.5
#: The heads of the three texts and the lines below them.
SYSTEM_HEAD = "[MEMORY — 核心记忆]\n以下是你已知的关键信息，请基于这些信息回应："
CONTEXT_HEAD = "[相关记忆]"
ARCHIVE_HEAD = "[历史参考]"
SYSTEM_LINE = ("\n记忆", " (共振: ", "%): ")
CONTEXT_MARK, ARCHIVE_MARK = "• ", "· "


def staged(found: DataFrame) -> DataFrame:
    """``found(question_id, entry_id, score)`` with the ``place`` in the result and a ``stage``: core (.7 or more, the first three), context (.35 or more, the first
    five of the others), archive. ``found`` is a result list: some tens of rows a question. Equal scores go by entry_id."""
    order = (F.desc("score"), F.asc("entry_id"))
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    core = placed.withColumn("is_core", F.coalesce((F.col("score") >= CORE_SCORE) & (F.col("place") <= CORE), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("question_id", "is_core").orderBy(*order))
    stage = F.when(F.col("is_core"), "core").when((F.col("score") >= CONTEXT_SCORE) & (nth <= CONTEXT), "context").otherwise("archive")
    return core.select("*", stage.alias("stage"), nth.alias("nth")).drop("is_core", "nth")


def _line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def rendered(found: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a question: ``n_core, n_context, n_archive``, the texts ``system`` (core memories whole), ``context`` (core and context, cut to 200 and 150 characters) and
    ``archive`` (ten titles with their days), ``tokens`` of all three, ``baseline_tokens`` of the contents whole, and by how many percent the former are fewer.

    ``entries(entry_id, title, content, created_at in epoch seconds)``, one row an entry. Null titles and contents are empty; percentages of scores are rounded half to
    even; results whose entry is gone do not count for places. A question without results has no row.
    """
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = staged(found.join(entries.select("entry_id", text("title"), text("content"), "created_at"), "entry_id"))
    day = F.date_format(F.timestamp_seconds("created_at"), "MM-dd")
    nth = F.row_number().over(Window.partitionBy("question_id", "stage").orderBy("place"))
    percent = F.bround(F.col("score") * 100).cast("long").cast("string")
    lines = rows.withColumn("nth", nth).select(
        "question_id", "place", "stage", "nth", F.char_length("content").alias("chars"),
        F.when(F.col("stage") == "core", _line(SYSTEM_LINE[0], F.col("nth").cast("string"), SYSTEM_LINE[1], percent, SYSTEM_LINE[2], F.col("content"))).alias("system"),
        F.when(F.col("stage") != "archive", _line(CONTEXT_MARK, F.col("title"), ": ", F.left("content", F.when(F.col("stage") == "core", 200).otherwise(150)))).alias("context"),
        F.when((F.col("stage") == "archive") & (F.col("nth") <= ARCHIVE), _line(ARCHIVE_MARK, F.col("title"), " (", day, ")")).alias("archive"),
    )
    # three, eight and ten lines a question at most: nulls are not collected
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", F.col(c).alias("line"))))), lambda x: x["line"]), "\n")
    stages = [F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in ("core", "context", "archive")]
    each = lines.groupBy("question_id").agg(*stages, *(joined(c).alias(c) for c in ("system", "context", "archive")), (F.sum("chars") + F.count("*") - 1).alias("all_chars"))
    headed = lambda c, head, any_: F.when(any_, _line(head, "\n", F.col(c))).otherwise(F.col(c)).alias(c)
    texts = each.select(
        "question_id", "n_core", "n_context", "n_archive", "all_chars", headed("system", SYSTEM_HEAD, F.col("n_core") > 0), headed("context", CONTEXT_HEAD, F.col("n_core") > 0),
        headed("archive", ARCHIVE_HEAD, F.col("n_archive") > 0),
    )
    full = F.concat_ws("\n", *(F.when(F.col(c) != "", F.col(c)) for c in ("system", "context", "archive")))
    counted = texts.withColumns({"tokens": F.floor(F.char_length(full) * CHARS_PER_TOKEN), "baseline_tokens": F.floor(F.col("all_chars") * CHARS_PER_TOKEN)})
    saved = F.when(F.col("baseline_tokens") > 0, F.greatest(F.lit(0.0), F.round((1 - F.col("tokens") / F.col("baseline_tokens")) * 100, 1))).otherwise(0.0)
    return counted.drop("all_chars").withColumn("saved", saved)
