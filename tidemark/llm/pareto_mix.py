"""Mixing sources to target weights by Pareto order sampling.

Targets: the weights share a multiple of all words; a source stops at ``max_repeat`` times its own words and
the excess goes to the others by weight. Within a source every document has an expected number of copies that rises with its
length class and reaches the target in sum: its whole part is certain, its fraction is an inclusion probability p. The rest of
the target is drawn by order sampling: documents are ranked by (U / (1 - U)) / (p / (1 - p)), U a hash of the id, and taken
in that order while the words last; of those past the cut, the one that lands nearest to the target goes in, if any does.

Ranks are cut with histograms of fixed size: words by (source, rank bin), then by finer bins within the bin of the cut, then
the documents of the single bin that is left, so no task sorts a source.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, boxed, cut, unboxed

WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEAT = 1.5, 2.0
LENGTH_BIAS = 0.15
SEED = 20240501
#: Bins of the rank of a source, and again within the bin of the cut: 2 ** 24 of them in all.
BINS = 1 << 12
FEW_SOURCES = 20_000


def spread(total: float, weights: Iterable[float], limits: Iterable[float]) -> list[float]:
    """Share ``total`` by weight; no share passes its limit, and what is over goes to the rest by weight."""
    weights, limits = list(weights), list(limits)
    out, open_ = [0.0] * len(weights), set(range(len(weights)))
    left = min(total, sum(limits))
    while open_:
        heft = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] / heft > limits[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / heft
            break
        for i in full:
            out[i] = float(limits[i])
        left = max(0.0, left - sum(limits[i] for i in full))
        open_ -= set(full)
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target``. One row a source, solved in one place: the table of sources is small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # code point order, null last
        rows = sorted(pdf.itertuples(index=False), key=lambda r: (r.source is None, r.source or ""))
        got = spread(SHARE * sum(r.source_size for r in rows), [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))], [MAX_REPEAT * r.source_size for r in rows])
        return pd.DataFrame({"source": [r.source for r in rows], "source_size": [r.source_size for r in rows], "target": got})

    return per.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "source string, source_size long, target double")


def copies(pdf: pd.DataFrame, bias: float, most: float) -> pd.DataFrame:
    """Expected copies of each length class of one source: c * mean_length ** bias, at most ``most``, worth the target in words."""
    words, target = pdf["words"].to_numpy(float), float(pdf["target"].iloc[0])
    heft = [(w / n) ** bias if w else 0.0 for w, n in zip(words, pdf["rows"], strict=True)]
    low, high = 0.0, 1.0
    worth = lambda c: sum(min(most, c * h) * w for h, w in zip(heft, words, strict=True))
    while worth(high) < target * (1 - 1e-12) and high < 1e9:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if worth(mid) < target else (low, mid)
    return pdf.assign(copies=[min(most, high * h) for h in heft])[["source", "grade", "copies"]]


def _with(left: DataFrame, right: DataFrame, how: str = "inner", small: bool = False) -> DataFrame:
    """Join on the source; null equals null. ``small``: the right side, a row a source, is known to be within FEW_SOURCES."""
    right = right.withColumnRenamed("source", "their_source")
    return left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["their_source"]), how).drop("their_source")


def _uniform(*columns: str | Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _cuts(rows: DataFrame, bins: str, need: DataFrame, few: bool) -> DataFrame:
    """The bin of each source in which its documents, by rank, come to ``need`` words, and what is needed of that bin. At most BINS bins a source meet in a window."""
    per_bin = rows.groupBy("source", F.col(bins).alias("cut_bin")).agg(F.sum("size").alias("words"))
    run = per_bin.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("cut_bin")))
    return cut(_with(run, need, small=few).where("upto > need and upto - words <= need").select("source", "cut_bin", (F.col("need") - F.col("upto") + F.col("words")).alias("spare")))


def pareto_mix(docs: DataFrame, bias: float = LENGTH_BIAS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source, ...)``.

    Null or empty texts have size 0 and are never taken. Null sources are one source, last in order. Equal ranks (repeated rows)
    are cut in the order (rank, doc_id, size); which of two wholly equal rows goes in makes the same table.
    An empty table gives no rows. Other columns are ignored.
    """
    sizes = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    ))
    aims = cut(targets(sizes))
    few = aims.count() <= FEW_SOURCES
    graded = sizes.withColumn("grade", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1))
    grades = graded.groupBy("source", "grade").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    grades = _with(grades, aims, small=few).select("source", "grade", "words", "rows", "target")
    plan = grades.groupBy("source").applyInPandas(lambda pdf: copies(pdf, bias, MAX_REPEAT), "source string, grade long, copies double")
    plan = cut(_with(plan, aims).select("source", "grade", "copies", "source_size", "target"))
    # at most 64 grades a source: joined on the source as one row each
    plan = plan.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("grade", "copies"))).alias("plan"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    drawn = _with(graded, plan, small=few).withColumn("copies", F.element_at("plan", F.col("grade"))).select(
        "doc_id", "source", "size", "row", "source_size", "target", F.floor(F.col("copies") + 1e-9).alias("whole"), "copies"
    )
    odds = lambda p: p / (1 - p)
    chance = F.greatest(F.lit(0.0), F.col("copies") - F.col("whole"))
    rank = odds(_uniform("doc_id", "size")) / odds(F.col("chance"))
    drawn = drawn.withColumn("chance", F.when(F.col("size") > 0, chance).otherwise(0.0)).withColumn("open", F.col("chance") > 1e-9)
    # a monotone picture of the rank in [0, 1), for the bins
    drawn = cut(drawn.withColumn("rank", F.when(F.col("open"), rank / (1 + rank))))
    whole = drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = cut(_with(aims, whole).select("source", (F.col("target") - F.col("certain")).alias("need")))
    coarse, fine = F.floor(F.col("rank") * BINS), F.floor(F.col("rank") * BINS * BINS)
    drawn = drawn.withColumn("coarse", F.least(F.lit(BINS - 1), coarse)).withColumn("fine", F.least(F.lit(BINS * BINS - 1), fine))
    first = _cuts(drawn.where("open"), "coarse", need, few)
    within = _with(drawn.where("open"), first, small=few).where("coarse = cut_bin")
    cuts = _cuts(within, "fine", first.select("source", F.col("spare").alias("need")), few)
    # without a coarse cut all open documents go in; without a fine one the cut lies after the last document of the coarse bin
    cuts = _with(first.select("source", F.col("cut_bin").alias("cut_coarse")), cuts, "left", few).select("source", "cut_coarse", F.col("cut_bin").alias("cut_fine"), "spare")
    marked = _with(drawn, cuts, "left", few)  # one row a source at most
    at_cut = F.col("open") & F.col("fine").eqNullSafe(F.col("cut_fine"))
    inside = marked.where(at_cut)
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "row")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("extra", (before + F.col("size") <= F.col("spare")).cast("long"))
    early = F.expr("cut_coarse is null or coarse < cut_coarse or (coarse = cut_coarse and (cut_fine is null or fine < cut_fine))")
    rest = marked.where(~at_cut).withColumn("extra", (F.col("open") & early).cast("long"))
    ranked = cut(rest.unionByName(inside).drop("coarse", "fine", "cut_coarse", "cut_fine", "spare", "open", "copies"))
    # of the documents past the cut, one goes in if it lands nearer to the target than none
    short = _with(need, ranked.groupBy("source").agg(F.sum(F.col("extra") * F.col("size")).alias("drawn"))).select("source", (F.col("need") - F.col("drawn")).alias("short"))
    over = _with(ranked.where("extra = 0 and chance > 1e-9"), short, small=few).withColumn("miss", F.abs(F.col("size") - F.col("short"))).where("miss < short")
    closing = over.groupBy("source").agg(F.min(F.struct("miss", "rank", "doc_id", "row")).alias("last")).select("source", F.col("last.row").alias("closing"))
    taken = F.col("size") * (F.col("whole") + F.col("extra") + F.coalesce((F.col("row") == F.col("closing")).cast("long"), F.lit(0)))
    return _with(ranked, closing, "left", few).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def mix_rows(docs: DataFrame, bias: float = LENGTH_BIAS) -> DataFrame:
    """``docs`` as the mix takes it: each row as often as its copies say, with its own columns, whatever their names.

    Rows that agree in id, source and words share their copies evenly: the first ones, in no order, get the odd copy.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    taken = pareto_mix(docs, bias).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum(F.expr("taken div size")).alias("copies"))
    taken = taken.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), "copies")
    rows = boxed(docs, F.col("doc_id").cast("long").alias("row_id"), F.col("source").cast("string").alias("row_source"), size.alias("row_size"))
    match = rows["row_id"].eqNullSafe(taken["mix_id"]) & rows["row_source"].eqNullSafe(taken["mix_source"]) & (rows["row_size"] == taken["mix_size"])
    alike = Window.partitionBy("mix_id", "mix_source", "mix_size")
    joined = rows.join(taken, match).withColumn("alike", F.count("*").over(alike)).withColumn("nth", F.row_number().over(alike.orderBy(F.xxhash64("doc.text"))))
    times = joined.withColumn("times", F.expr("copies div alike + if(nth <= copies % alike, 1, 0)"))
    return unboxed(times.withColumn("copy", F.explode(F.expr("if(times > 0, sequence(1, cast(times as int)), array())"))), docs.columns)
