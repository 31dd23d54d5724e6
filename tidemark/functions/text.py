"""Text functions on built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latin_words(text: Column) -> Column:
    """Lower-cased runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def han_tokens(text: Column) -> Column:
    """Every Han character and every pair of neighbours, over all Han characters of the text in a row."""
    han = F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]+", "")
    n = F.char_length(han)
    singles = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(han, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(singles, pairs)


def search_tokens(text: Column) -> Column:
    """Tokens for ranking: Latin words, then Han characters and pairs."""
    return F.concat(latin_words(text), han_tokens(text))


def space_words(text: Column) -> Column:
    """Distinct words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; two empty sets have none."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def edit_distance(a: Column, b: Column, prefix: int = 500) -> Column:
    """Levenshtein distance of the beginnings over the longer length."""
    a, b = F.left(a, F.lit(prefix)), F.left(b, F.lit(prefix))
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(most > 0, F.levenshtein(a, b) / most).otherwise(F.lit(0.0))


#: Cue expressions of the memory types, tested in this order on lower-cased text; none means an event.
MEMORY_TYPES = (
    ("absence", r"(没有|不会|不能|不可以|无法|禁止)|(doesn't|can't|cannot|never|no\s+\w+)"),
    ("plan", r"(计划|打算|将要|准备|预计|安排|预约)|(plan|will|going|schedule|appointment)"),
    ("preference", r"(喜欢|偏好|讨厌|习惯|爱|不喜欢|常用|擅长)|(prefer|like|love|hate|favorite|usually|always)"),
    ("relationship", r"(是.*的.*|认识|朋友|同事|家人|同学|老板|上司)|(is\s+(my|a|the).*|knows|friend|colleague)"),
    ("state", r"(住|在|工作|担任|任职|就职|供职)|(live|work|stay|reside|employ)"),
)
#: Cue expressions of what a question is after, tested in this order; none means any time.
INTENTS = (
    ("current_state", r"(现在|目前|当前|如今).*(住|在|工作|做|是|用|喜欢|吃)|where\s+(do|does).*(live|work|stay|now)|(现在|目前|当前).*(什么|哪|谁|怎么)"),
    ("historical_range", r"(去年|前年|以前|之前|过去|曾经|当时|那时候)|(上[个周月]|昨天|前天|上周|上月|去年)|(what|where).*(happen|did|was|were).*(last|ago|before|previous)"),
    ("upcoming", r"(计划|打算|将要|即将|准备|下周|下个|明天|后天|明年)|(这[周月年]|今[天晚]|明天).*(做什么|计划|安排)|what.*(plan|next|upcoming|this week)"),
    ("duration", r"(多久|多长时间|几年|几个月|几天)|how\s+long"),
    ("specific_date", r"[0-9]{1,2}月[0-9]{1,2}[日号]|[0-9]{4}[年/-][0-9]{1,2}[月/-][0-9]{1,2}|(星期[一二三四五六日]|周[一二三四五六日])"),
)
#: Predicates that name a state, in this order.
STATE_PREDICATES = ("住", "工作", "担任", "任职", "就职", "供职", "在")
#: An expression and its negation.
NEGATIONS = (
    ("是", "不是"), ("喜欢", "不喜欢"), ("喜欢", "讨厌"), ("支持", "反对"), ("支持", "不支持"), ("有", "没有"), ("有", "无"), ("存在", "不存在"), ("在", "不在"),
    ("记得", "不记得"), ("能", "不能"), ("可以", "不可以"), ("会", "不会"), ("要", "不要"), ("true", "false"), ("yes", "no"), ("是", "否"), ("是", "非"),
)


def first_cue(text: Column, cues: tuple[tuple[str, str], ...], other: str) -> Column:
    """Name of the first expression found in the lower-cased text."""
    out = None
    for name, cue in cues:
        hit = F.lower(text).rlike(cue)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def intent(text: Column) -> Column:
    """What time a question is about."""
    return first_cue(text, INTENTS, "any")


def state_key(scope: Column, text: Column) -> Column:
    """Names what a state is about: the first predicate it holds, else its beginning."""
    out = F.regexp_replace(F.left(text, F.lit(6)), " ", "")
    for predicate in reversed(STATE_PREDICATES):
        out = F.when(F.contains(text, F.lit(predicate)), predicate).otherwise(out)
    return F.concat(scope, F.lit(":state:"), out)


def memory_type(text: Column) -> Column:
    """First matching type, else an event."""
    return first_cue(text, MEMORY_TYPES, "event")


def judge_tokens(text: Column) -> Column:
    """Distinct Latin words and one to three Han characters in a row."""
    han = F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]+", "")
    triples = F.when(F.char_length(han) > 2, F.transform(F.sequence(F.lit(1), F.char_length(han) - 2), lambda i: F.substring(han, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(latin_words(text), han_tokens(text), triples))


def word_runs(text: Column) -> Column:
    """Distinct runs of Han characters or of Latin letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\x{4e00}-\x{9fff}]+|[a-z]+)"), F.lit(1)))
