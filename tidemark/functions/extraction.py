"""Names, beliefs, facts, dates, numbers and vectors taken out of text; all but the tagger of names are built-in expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names look like, kind by kind, in the order in which kinds are looked for.
PERSON_HAN = re.compile(
    "[刘张李王陈杨赵黄周吴徐孙马胡朱郭何罗高林郑梁谢唐许冯宋韩邓彭曹曾田萧潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾郝毛龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞]"
    r"[^\s\d，。！？、；：""''（）【】《》!-/:-@[-`{-\u007fa-zA-Z和与的去了吗呢吧啊在从到给为被把让对就跟也会能可以这那什么怎么但而虽因所以及或]{1,2}"
)
PLACE_HAN = re.compile(r"[一-鿿]{2,8}?(?:省|市|区|县|镇|村|路|街|广场|大厦|中心)")
GROUP_HAN = re.compile(r"[一-鿿]{2,10}?(?:公司|集团|大学|学院|医院|银行|研究所|实验室|平台)")
PRODUCT = re.compile(
    r"\b(?:Python|Java|Go|Rust|React|Vue|Angular|Docker|Kubernetes|K8s|SQLite|PostgreSQL|MySQL|MongoDB|Redis|Kafka|PyTorch|TensorFlow|MLX|Ollama|LangChain|CrewAI|"
    r"FastAPI|Flask|Django|Node\.js|TypeScript|JavaScript|MacOS|Linux|Windows|iOS|Android|GitHub|GitLab|AWS|GCP|Azure)\b"
)
PLACE_LATIN = re.compile(
    r"((?:[A-Z][a-z]*\.?\s*){1,3}(?:City|Town|Village|County|State|Province|Region|District|Island|Mountain|River|Lake|Ocean|Sea|Bay|Gulf|Valley|Forest|Park|Beach|Coast"
    r"|Harbor|Port|Airport|Station|Square|Street|Avenue|Road|Lane|Drive|Boulevard|Highway|Bridge|Tower|Building|Center|Hall|Palace|Castle|Temple|Church|Mosque"
    r"|Museum|Theatre|Stadium|Arena|Market|Mall|Plaza|Heights|Gardens|Hills|Springs))"
)
GROUP_LATIN = re.compile(
    r"((?:[A-Z][a-z]*\.?\s*)+(?:Inc\.?|Corp\.?|LLC|Ltd\.?|Limited|GmbH|S\.A\.|Co\.?|Company|Corporation|Group|Holdings|Ventures|Capital|Partners|Associates|"
    r"Technologies|Solutions|Systems|Software|Networks|AI|Labs?|Research|Institute|University|College|School|Hospital|Bank|Foundation|Trust|Agency|Authority|Board|"
    r"Council|Commission|Bureau|Department|Ministry|Organization|Association|Society|Union|Federation|Alliance|Consortium|Platform))"
)
PERSON_LATIN = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b")
MOST_NAMES = 10

KINDS = ((PERSON_HAN, "person"), (PLACE_HAN, "location"), (GROUP_HAN, "organization"), (PRODUCT, "artifact"), (PLACE_LATIN, "location"), (GROUP_LATIN, "organization"))
NAMES = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string())]))


def tag_names(text: str) -> list[dict[str, str]]:
    """The first ten different names: all other kinds first, then Latin persons that share no character with one of them."""
    kinds: dict[str, str] = {}
    for pattern, kind in KINDS:
        for hit in pattern.finditer(text):
            kinds.setdefault(hit.group(), kind)
    persons = list(PERSON_LATIN.finditer(text))
    if persons and len(kinds) < MOST_NAMES:
        taken = bytearray(len(text))
        for label in kinds:
            for hit in re.finditer(re.escape(label), text):
                taken[hit.start() : hit.end()] = b"\1" * len(label)
        for hit in persons:
            if not any(taken[hit.start() : hit.end()]):
                kinds.setdefault(hit.group(), "person")
    return [{"label": label, "kind": kind} for label, kind in list(kinds.items())[:MOST_NAMES]]


def named_entities(text: Column) -> Column:
    """Array of ``label, kind``; null and empty texts have none. Whether a person's name overlaps another name needs places, so it runs on Arrow batches."""

    def tagged(texts: pa.Array) -> pa.Array:
        return pa.array([tag_names(x.as_py() or "") for x in texts], NAMES)

    return F.arrow_udf(tagged, "array<struct<label:string,kind:string>>")(text)


#: A noun that announces a name, in texts and in questions; the name is what follows.
NAMED_IN_TEXT = r"(?:公司|产品|项目|框架|工具|语言|协议)[：:]?\s*([^\s，。,\.]{2,30})"
NAMED_IN_QUESTION = r"(?:公司|产品|项目|框架|工具|语言|协议|人物|组织|事件)[：:]?\s*([^\s，。,\.]{2,30})"
#: How sure a belief is by the words before it.
BELIEFS = (
    ("confirmed", r"(?:我确定|肯定|一定是|毫无疑问)([^。！？\n]{5,50})"),
    ("tentative", r"(?:我觉得|我认为|倾向于)([^。！？\n]{5,50})"),
    ("speculative", r"(?:可能|也许|大概|或许|说不定)([^。！？\n]{5,50})"),
)
#: Words of a question worth looking for.
KEYWORDS = "([一-鿿]{2,}|[a-zA-Z]{3,})"
#: Facts of a profile by the words they hold; the first that is found counts.
FACTS = (
    ("preference", "喜欢|偏好|爱用|习惯|倾向|首选|常用|最喜欢|最爱"), ("tool", "使用|在用|用了|选择|采用|决定用|换成"), ("location", "住在|居住|地址|搬到|搬家"),
    ("job", "工作在|担任|就职|入职|加入.*公司|在.*上班"), ("learning", "学习|研究|探索|尝试|实验"), ("project", "项目|正在做|开发|搭建|构建|建设"),
    ("goal", "目标|计划|打算|想要|希望|期望"), ("dislike", "不喜欢|讨厌|避免|不用|放弃|拒绝"), ("tech_stack", "语言|编程|代码|技术|框架|工具链"), ("people", "团队|同事|老板|客户|合作伙伴"),
)
#: Hints of time in a question, the first that it holds counts: days from today, or a week, or nothing known.
TIME_HINTS = (
    ("今天", 0), ("昨天", -1), ("前天", -2), ("本周", "this week"), ("上周", "last week"), ("本月", None), ("上月", None), ("刚才", 0), ("刚刚", 0), ("最近", None), ("之前", None), ("以前", None),
)
#: Numbers by name.
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def names_after(text: Column, cue: str = NAMED_IN_TEXT) -> Column:
    """The first ten names that a noun announces."""
    return F.slice(F.regexp_extract_all(text, F.lit(cue), F.lit(1)), 1, 10)


def beliefs(text: Column) -> Column:
    """Array of ``content, confidence``, the surest first."""

    def found(level: str, cue: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(cue), F.lit(1)), lambda b: F.struct(F.trim(b).alias("content"), F.lit(level).alias("confidence")))

    return F.concat(*(found(level, cue) for level, cue in BELIEFS))


def keywords(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(KEYWORDS), F.lit(1))


def fact(text: Column, cue: str) -> Column:
    """Five characters before the first match to forty after it, cut behind the first of 。！？.!? that is in there; without a match the first 80."""
    hit = F.regexp_extract(text, f"(?s)^(.*?)(?:{cue})", 1)
    end = F.char_length(F.regexp_extract(text, f"(?s)^(.*?(?:{cue}))", 1))
    start = F.greatest(F.lit(0), F.char_length(hit) - 5)
    near = F.trim(F.substring(text, start + 1, end + 40 - start))
    out = near
    for sign in reversed("。！？.!?"):
        at = F.instr(near, sign)
        out = F.when(at > 1, F.left(near, at)).otherwise(out)
    return F.when(text.rlike(cue), out).otherwise(F.left(text, F.lit(80)))


def time_hint(text: Column, now: Column) -> Column:
    """Struct ``after, before`` of dates, the end left out; null where nothing is said. ``now`` is given, so that reruns agree."""
    today = F.to_date(now)
    monday = F.to_date(F.date_trunc("week", now))
    none = F.lit(None).cast("date")
    span = lambda a, b: F.struct(a.alias("after"), b.alias("before"))
    out = None
    for hint, what in TIME_HINTS:
        if what == "this week":
            value = span(monday, none)
        elif what == "last week":
            value = span(F.date_sub(monday, 7), monday)
        elif what is None:
            value = span(none, none)
        else:
            value = span(F.date_add(today, what), F.date_add(today, what + 1))
        hit = F.contains(text, F.lit(hint))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(span(none, none))


def date_variants(text: Column) -> Column:
    """A date such as ``March 5th`` as it is, then ``Mar 5``, ``March 5``, ``3/5`` and ``3-5``; anything else as it is."""
    bare = F.trim(text)
    month, day = F.regexp_extract(bare, r"(?i)^(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?", 1), F.regexp_extract(bare, r"(?i)^(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?", 2)
    number = F.array_position(F.array(*(F.lit(m.lower()) for m in MONTHS)), F.lower(month))
    short = F.initcap(F.left(month, F.lit(3)))
    known = F.array(bare, F.concat_ws(" ", short, day), F.concat_ws(" ", month, day), F.concat_ws("/", number.cast("string"), day), F.concat_ws("-", number.cast("string"), day))
    return F.when(number > 0, known).otherwise(F.array(bare))


def named_numbers(text: Column) -> Column:
    """Array of the numbers a text names, in order; digits and names alike."""
    said = F.regexp_extract_all(F.lower(text), F.lit(r"\b([0-9]{1,18}|" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + r")\b"), F.lit(1))
    values = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    return F.transform(said, lambda w: F.coalesce(F.try_element_at(values, w).cast("long"), w.try_cast("long")))


def hash_embedding(rows: DataFrame, key: str, text: str, dims: int = 1024) -> DataFrame:
    """``key, dim, value``: the non-zero places of a unit vector of the distinct runs of one to four characters of the lower-cased text.

    The MD5 of a run moves four places, each by one up or down. Rows of one key are one text; empty texts have no places. The runs of a text are rows of their own, so a long
    text is spread over tasks.
    """
    bare = rows.select(key, F.lower(text).alias("t")).where(F.char_length("t") > 0)
    starts = bare.select(key, "t", F.explode(F.sequence(F.lit(1), F.char_length("t"))).alias("at"))
    piece = lambda n: F.when(F.col("at") + n - 1 <= F.char_length("t"), F.substring("t", F.col("at"), F.lit(n)))
    runs = starts.select(key, F.explode(F.array(*(piece(n) for n in range(1, 5)))).alias("run")).where("run IS NOT NULL").distinct()
    byte = lambda k: F.conv(F.substring("md5", 2 * k + 1, 2), 16, 10).cast("int")
    moves = [F.struct(((byte(4 * k) + 256 * byte(4 * k + 1) + 65536 * byte(4 * k + 2) + 16777216 * byte(4 * k + 3).cast("long")) % dims).cast("int").alias("dim"), F.when(byte(k) >= 128, 1).otherwise(-1).alias("by")) for k in range(4)]
    moved = runs.withColumn("md5", F.md5(F.col("run").cast("binary"))).select(key, F.explode(F.array(*moves)).alias("m"))
    sums = moved.groupBy(key, "m.dim").agg(F.sum("m.by").alias("v")).where("v <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, key).select(key, "dim", (F.col("v") / F.col("norm")).alias("value"))
