"""Memories as rows of plain columns: lists as JSON text, times as ISO text, flags as 0 and 1; and back, with a count of what could not be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of what a memory lists, as they are written.
ENTITY = {"entity_id": "string", "label": "string", "entity_type": "string", "aliases": "array<string>", "description": "string"}
ANCHOR = {"anchor_id": "string", "event_at": "timestamp", "recorded_at": "timestamp", "relative_expression": "string", "precision": "string"}
BELIEF = {"belief_id": "string", "content": "string", "confidence": "string", "source": "string", "adopted_at": "timestamp", "superseded_by": "string", "superseded_at": "timestamp"}
STRUCTS = {"entities": ENTITY, "anchors": ANCHOR, "beliefs": BELIEF}
TEXTS = ("tags", "related_ids")
TIMES = ("created_at", "touched_at", "event_start", "event_end")
PLAIN = ("entry_id", "tier", "title", "content", "scope_type", "scope_id", "parent_id", "state_key", "temporal_precision", "decay", "hits")
#: The types a memory can have, and what fields are where nothing is written.
MEMORY_TYPES = ("event", "state", "plan", "preference", "relationship", "absence", "timeless")
DEFAULTS = {"title": "", "content": "", "scope_type": "tenant", "scope_id": "", "state_key": "", "temporal_precision": "day", "decay": 1.0, "hits": 0}
ENTITY_DEFAULTS = {"entity_type": "concept", "description": ""}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _ddl(fields: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">>"


MEMORY = (
    "entry_id bigint, tier string, title string, content string, scope_type string, scope_id string, parent_id bigint, state_key string, temporal_precision string, decay double, hits bigint, "
    "tags array<string>, related_ids array<string>, " + ", ".join(f"{n} {_ddl(f)}" for n, f in STRUCTS.items()) + ", created_at timestamp, touched_at timestamp, event_start timestamp, "
    "event_end timestamp, memory_type string, is_active boolean"
)


def instant(text: Column) -> Column:
    """The time that ISO text names; text without a zone is UTC, anything else null."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), bare).otherwise(F.concat(bare, F.lit("Z"))).try_cast("timestamp")


def encode(memories: DataFrame, *keep: str) -> DataFrame:
    """`MEMORY` rows as rows of plain columns, with the further columns of ``keep``. Null lists are empty ones; fields that are null inside a list are written as null, so that nothing is lost."""

    out = [F.col(c) for c in PLAIN]
    for name in TEXTS:
        out.append(F.coalesce(F.to_json(name), F.lit("[]")).alias(f"{name.removesuffix('_ids')}_json"))
    for name, fields in STRUCTS.items():
        written = F.transform(name, _writer(fields))
        out.append(F.coalesce(F.to_json(written, {"ignoreNullFields": "false"}), F.lit("[]")).alias(f"{name}_json"))
    out += [F.date_format(c, ISO).alias(c) for c in TIMES]
    return memories.select(*out, "memory_type", F.col("is_active").cast("int").alias("is_active"), *keep)


def _writer(fields: dict[str, str]) -> Callable[[Column], Column]:
    def write(e: Column) -> Column:
        values = [(F.date_format(e[n], ISO) if kind == "timestamp" else e[n]).alias(n) for n, kind in fields.items()]
        return F.when(e.isNotNull(), F.struct(*values))

    return write


def _listed(text: Column) -> Column:
    """The elements of a JSON list; null where the text is no list. Null and empty texts are empty lists."""
    empty = F.array().cast("array<variant>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"))


def _structs(text: Column, fields: dict[str, str], label: str | None) -> Column:
    def read(e: Column) -> Column:
        is_text = F.schema_of_variant(e) == "STRING"
        values = []
        for name, kind in fields.items():
            raw = F.try_variant_get(e, f"$.{name}", "string" if kind == "timestamp" else kind)
            value = instant(raw) if kind == "timestamp" else raw
            if label is not None and name in ENTITY_DEFAULTS:
                value = F.when(F.try_variant_get(e, f"$.{name}", "variant").isNull(), ENTITY_DEFAULTS[name]).otherwise(value)
            values.append((F.when(is_text, F.try_variant_get(e, "$", "string")).otherwise(value) if name == label else value).alias(name))
        return F.when(~F.is_variant_null(e), F.struct(*values))

    return F.transform(_listed(text), read)


def decode(rows: DataFrame, *keep: str) -> DataFrame:
    """`MEMORY` of rows of plain columns, and ``n_bad``: how many of a row's lists and times could not be read; those are null.

    Columns that a tier lacks may be missing: ``source_json`` stands for ``related_json``, lists are empty, the rest has its default. An entity may be its name alone.
    Unknown types of memory are timeless. Further columns go, but for those of ``keep``.
    """
    has = set(rows.columns)
    lit = lambda c: F.lit(DEFAULTS.get(c))
    plain = {c: F.coalesce(F.col(c), lit(c)) if c in has and c in DEFAULTS else F.col(c) if c in has else lit(c) for c in PLAIN}
    text = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    sources = {name: text(f"{name.removesuffix('_ids')}_json") for name in (*TEXTS, *STRUCTS)}
    if "related_json" not in has:
        sources["related_ids"] = text("source_json")
    lists = {name: F.transform(_listed(sources[name]), lambda e: F.try_variant_get(e, "$", "string")) for name in TEXTS}
    lists |= {name: _structs(sources[name], fields, "label" if name == "entities" else None) for name, fields in STRUCTS.items()}
    times = {c: instant(text(c)) for c in TIMES}
    times["touched_at"] = F.when(text("touched_at").isNull(), times["created_at"]).otherwise(times["touched_at"])
    bad = [F.when(lists[n].isNull(), 1).otherwise(0) for n in lists] + [F.when(text(c).isNotNull() & (text(c) != "") & instant(text(c)).isNull(), 1).otherwise(0) for c in TIMES]
    kind = F.when(text("memory_type").isin(*MEMORY_TYPES), text("memory_type")).otherwise("timeless")
    active = F.coalesce(F.col("is_active") != 0, F.lit(True)) if "is_active" in has else F.lit(True)
    types = {"entry_id": "bigint", "parent_id": "bigint", "hits": "bigint", "decay": "double"}
    out = [c.cast(types.get(n, "string")).alias(n) for n, c in plain.items()] + [c.alias(n) for n, c in (lists | times).items()]
    return rows.select(*out, kind.alias("memory_type"), active.alias("is_active"), sum(bad[1:], bad[0]).alias("n_bad"), *keep)
