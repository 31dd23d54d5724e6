"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Seeds are the matches of four base patterns that pass their checks. The word before, the two words before and the word after seeds
and other tokens that look like identifiers, whatever their shape, are lexical patterns. A pattern's confidence is its precision for a kind over its distinct
values that are known, those of which nothing is known counting for a quarter; a value's confidence is the noisy-or over its patterns. Both are scored in turn for a few rounds
over the pattern-value graph of the whole corpus. Values that end confident enough are added as spans, with the kind their patterns point to. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, cut, join_counted, unboxed

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run of characters that cannot match from its first place cannot match from a later one, so matches
#: begin where a run does or where the last match ended: the same matches, in linear time. Possessive where nothing follows.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
#: Up to eight groups of digits with a space between two of them, or else one token with a digit or an @.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:[\x21-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7E]*+[0-9][0-9().+/-]*+(?:\x20\(?[0-9]{2}[0-9().-]*+(?![^\x20\x09-\x0D,;:!?\]\"'])){1,7}+[^\x20\x09-\x0D]*+"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: What does not belong to a candidate: a plus before a number and an area code in brackets do.
LEAD = r"^(?:(?![+(])\p{Punct}|\+(?![0-9(])|\((?![0-9]{1,5}\).))*+"
TRAIL = r"\p{Punct}+$"
EDGE = r"[\x20\x09-\x0D]"
ROUNDS = 3
WINDOW = 64
NEAR = 64  # characters beside a match in which its patterns are looked for
MIN_KNOWN, MIN_CONFIDENCE, ACCEPT, DOUBT = 4, 0.75, 0.9, 0.25
SPAN = "array<struct<kind: int, start: int, stop: int, value: string>>"
FOUND = "array<struct<kind: int, start: int, stop: int, value: string, before: string, after: string>>"


def _with(value: Column, then) -> Column:
    """``then(value)``, the value computed once however often it is used, even inside further lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(sizes: Column) -> Column:
    """Sums of the sizes before each place of an array. Sums of blocks of about the root of the length are made first, so that an array of n
    costs n ** 1.5 steps, not n ** 2."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    root = lambda a: F.ceil(F.sqrt(F.size(a))).cast("int")
    blocks = lambda a, b: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / b).cast("int")), lambda k: total(F.slice(a, k * b + 1, b)))
    before = lambda s: F.transform(s, lambda x, i: total(F.slice(s, F.lit(1), i)))
    place = lambda a, b, p: F.transform(a, lambda x, i: F.element_at(p, F.floor(i / b).cast("int") + 1) + total(F.slice(a, F.floor(i / b).cast("int") * b + 1, i % b)))
    made = _with(sizes, lambda a: _with(root(a), lambda b: _with(_with(blocks(a, b), before), lambda p: place(a, b, p))))
    return F.when(F.size(sizes) > 0, made).otherwise(F.array().cast("array<int>"))


MATCH = "array<struct<start: int, stop: int, value: string, before: string, after: string>>"


def _places(text: Column, pattern: str, hint: str | None) -> Column:
    """Leftmost matches without overlap, as (start, stop, value, text before, text after): the gaps between them tell where they are.

    The texts beside a match are what stands between it and its neighbours, up to ``NEAR`` characters.
    """
    def made(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda v, i: F.char_length(F.element_at(gaps, i + 1)) + F.char_length(v))
        return _with(_running(sizes), lambda ends: F.transform(found, lambda v, i: F.struct(
            (F.element_at(ends, i + 1) + F.char_length(F.element_at(gaps, i + 1))).cast("int").alias("start"),
            (F.element_at(ends, i + 1) + F.char_length(F.element_at(gaps, i + 1)) + F.char_length(v)).cast("int").alias("stop"),
            v.alias("value"), F.right(F.element_at(gaps, i + 1), F.lit(NEAR)).alias("before"), F.left(F.element_at(gaps, i + 2), F.lit(NEAR)).alias("after"),
        )))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    all_ = _with(found, lambda f: F.when(F.size(f) > 0, _with(F.split(text, pattern, -1), lambda g: made(f, g))).otherwise(F.array().cast(MATCH)))
    return all_.cast(MATCH) if hint is None else F.when(F.contains(text, F.lit(hint)), all_.cast(MATCH)).otherwise(F.array().cast(MATCH))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int") + F.substring(digits, i, F.lit(1)).cast("int") * 2 % 10),
    )
    return F.char_length(digits).between(13, 19) & (total % 10 == 0)


_PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.rlike(p, F.lit(_OCTET))),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def _passing(n: int, kind: str) -> Column:
    good = F.filter(f"at_{kind}", lambda x: _PASSES[kind](x["value"]))
    return F.transform(good, lambda x: F.struct(F.lit(n).alias("kind"), *(x[k].alias(k) for k in ("start", "stop", "value", "before", "after")))).cast(FOUND)


def _located(docs: DataFrame, *keep: str) -> DataFrame:
    """Adds ``found``, the matches of the base patterns by kind and start, and ``token``, what looks like an identifier."""
    # in steps, so that each match list is made once
    out = docs.withColumn("body", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS:
        out = out.withColumn(f"at_{kind}", _places(F.col("body"), PATTERNS[kind], HINTS[kind]))
    out = out.withColumn("token", _places(F.col("body"), TOKEN, None))
    return out.select(*keep, F.concat(*(_passing(n, kind) for n, kind in enumerate(KINDS))).alias("found"), "token")


def _apart(tokens: Column, found: Column) -> Column:
    """The tokens that overlap no span. A span holds 19 digits in groups at most, so what overlaps stands within ``WINDOW`` places in the order of the starts."""
    item = lambda is_token: lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(is_token).alias("token"), x.alias("row"))
    near = lambda a, x, i: F.exists(F.slice(a, F.greatest(F.lit(1), i + 1 - WINDOW), F.lit(2 * WINDOW)), lambda b: ~b["token"] & (x["start"] < b["stop"]) & (b["start"] < x["stop"]))
    marked = lambda a: F.transform(a, lambda x, i: F.struct(x["row"].alias("row"), (x["token"] & ~near(a, x, i)).alias("free")))
    both = F.array_sort(F.concat(F.transform(tokens, item(True)), F.transform(found, item(False))))
    free = F.transform(F.filter(_with(both, marked), lambda y: y["free"]), lambda y: y["row"])
    return F.when((F.size(tokens) == 0) | (F.size(found) == 0), tokens).otherwise(free)


def _contexts(match: Column) -> Column:
    """Lexical patterns around a match: the word before, the two words before, the word after."""
    bare = lambda w: F.lower(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    one = bare(F.regexp_extract(match["before"], r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$", 1))
    two = bare(F.regexp_extract(match["before"], r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$", 1))
    after = bare(F.regexp_extract(match["after"], r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))
    tagged = F.array(
        F.when(one != "", F.concat(F.lit("before "), one)), F.when((one != "") & (two != ""), F.concat_ws(" ", F.lit("both"), two, one)), F.when(after != "", F.concat(F.lit("after "), after))
    )
    return F.filter(tagged, lambda x: x.isNotNull())


def _candidates(located: DataFrame, *keep: str) -> DataFrame:
    """Adds ``base``, the spans, and ``seen``: those and identifier-like tokens (five digits, in groups or not, or an @) off them, with their patterns."""
    def core(t: Column) -> Column:
        lead = F.char_length(F.regexp_extract(t["value"], LEAD, 0))
        value = F.regexp_replace(F.regexp_replace(t["value"], LEAD, ""), TRAIL, "")
        return _with(F.struct((t["start"] + lead).cast("int").alias("start"), value.alias("value")), lambda v: F.struct(
            F.lit(None).cast("int").alias("kind"), v["start"].alias("start"), (v["start"] + F.char_length(v["value"])).cast("int").alias("stop"),
            v["value"].alias("value"), t["before"].alias("before"), t["after"].alias("after"),
        ))

    likely = F.filter("token", lambda t: F.rlike(t["value"], F.lit("(?:[0-9][^0-9]*+){5}")) | F.contains(t["value"], F.lit("@")))
    out = located.withColumn("core", F.transform(likely, core).cast(FOUND))
    out = out.withColumn("free", _apart(F.col("core"), F.col("found")))
    seen = F.transform(F.concat("found", "free"), lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"), F.lower(t["value"]).alias("value"), _contexts(t).alias("patterns")))
    base = F.transform("found", lambda t: F.struct(*(t[k].alias(k) for k in ("kind", "start", "stop", "value")))).cast(SPAN)
    return out.select(*keep, base.alias("base"), seen.alias("seen"))


def _bootstrap(seen: DataFrame) -> DataFrame:
    """``value, kind`` of the values found by patterns, from ``seen(kind, value, patterns)`` of the whole corpus."""
    edges = seen.select("kind", "value", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    # a pattern with too few seeds of every kind can never pass, one without other values finds nothing
    sums = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("seeds"))
    live = sums.where((F.col("seeds") >= MIN_KNOWN) & (F.col("n") > F.col("seeds"))).select("pattern", "n")
    edges = cut(join_counted(cut(edges), live, "pattern", edges.count()))
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    known = seeds
    for _ in range(ROUNDS):
        by = edges.select("pattern", "n", "value").join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("known"), F.first("n").alias("n"))
        every = by.groupBy("pattern").agg(F.sum("known").alias("labelled"))
        by = by.join(every, "pattern")
        # precision over the labelled values; the others, of which nothing is known, count for a quarter
        trust = F.col("sum") / (F.col("labelled") + DOUBT * F.greatest(F.lit(0), F.col("n") - F.col("labelled")) + 1)
        patterns = by.select("pattern", "kind", trust.alias("trust"), "known").where((F.col("trust") >= MIN_CONFIDENCE) & (F.col("known") >= MIN_KNOWN)).select("pattern", "kind", "trust")
        fresh = edges.where("kind is null").select("pattern", "value").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999)))))).alias("score"))
        fresh = fresh.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("first"))).alias("best")).select("value", (-F.col("best.first")).alias("kind"), F.col("best.score").alias("score"))
        known = cut(seeds.union(fresh))
    return known.where((F.col("score") >= ACCEPT) & (F.col("score") < 1)).select("value", F.col("kind").cast("int").alias("found_kind"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, code, base, spans`` for every row of ``docs(doc_id, text, ...)``; code is a hash of id and text that joins spans to rows.

    Spans are (kind, start, stop, value), code points, by kind and start. Null text is empty and has none. Repeated rows have the same spans. Spans of
    different kinds may overlap, as base matches may. An empty table gives no rows; other columns are ignored.
    """
    code = F.concat_ws("-", F.hex(F.xxhash64("doc_id", "text")), F.hex(F.hash("text", "doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("code", code)
    made = cut(_candidates(_located(rows, "doc_id", "code"), "doc_id", "code"))
    each = made.select("code", F.explode("seen").alias("s"))
    values = _bootstrap(each.select("s.kind", "s.value", "s.patterns"))
    fresh = each.where("s.kind is null").select("code", "s.kind", "s.start", "s.stop", "s.value").join(values, "value").select("code", F.struct(F.col("found_kind").alias("kind"), "start", "stop", "value").alias("span"))
    fresh = fresh.groupBy("code").agg(F.collect_set("span").alias("more"))
    return made.join(fresh, "code", "left").select(
        "doc_id", "code", "base", F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN)))).alias("spans")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id", *(count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _clean(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds. Overlapping spans are one hole, named by the first of them."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"], F.struct((-s["less"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("out"))
    ).otherwise(F.struct(F.greatest(a["at"], -s["less"]).alias("at"), a["out"].alias("out")))
    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2147483647))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets, and ``n_chars``, where there is one, made to fit.

    Overlapping spans are one hole, named by the first. Rows without spans stay as they are; so do all other columns, whatever their names.
    """
    found = find_personal_data(docs).where(F.size("spans") > 0).groupBy("code").agg(F.first("spans").alias("spans"))
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    code = F.concat_ws("-", F.hex(F.xxhash64(doc_id, text)), F.hex(F.hash(text, doc_id)))
    joined = boxed(docs, code.alias("code"), text.alias("text")).join(found, "code", "left")
    clean = joined.withColumn("clean", F.when(F.col("spans").isNotNull(), _clean(F.col("text"), F.col("spans"))))
    hit = F.col("clean").isNotNull()
    changed = {"text": F.when(hit, F.col("clean")).otherwise(F.col("text")), "n_chars": F.when(hit, F.char_length("clean").cast("long")).otherwise(F.col("doc")["n_chars"]) if "n_chars" in docs.columns else None}
    return unboxed(clean, docs.columns, changed.get)
