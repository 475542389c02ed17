"""Tolerant parsing and normalisation of model answers, decisions and routes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("humorous", "reason", "reasoning", "cultural_category", "cultural_dependency", "detected_text", "visual_description", "cultural_context")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
NO_CONTEXT = "No specific cultural reference detected"
_OPTIONS = {"allowUnquotedControlChars": "true"}


def _object(text: Column) -> Column:
    """Struct of the known fields if the text is a JSON object with `humorous`; null otherwise."""
    whole = F.regexp_extract(text, r"(?s)^\s*(\{.*\})\s*$", 1)
    s = F.from_json(F.when(whole != "", whole), SCHEMA, _OPTIONS)
    return F.when(s["humorous"].isNotNull(), s)


def fenced(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))


def balanced(text: Column) -> Column:
    """The outermost balanced braces from the first opening one; null where they aren't closed. Braces in strings count, too."""
    at = F.instr(text, "{")
    rest = F.substring(text, F.when(at > 0, at).otherwise(F.length(text) + 1), F.length(text))
    chars = F.filter(F.transform(F.split(rest, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].isin("{", "}"))
    seed = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("end"))
    done = F.aggregate(chars, seed, lambda a, x: F.when(a["end"] >= 0, a).otherwise(F.struct((a["depth"] + F.when(x["c"] == "{", 1).otherwise(-1)).alias("depth"), F.when((x["c"] == "}") & (a["depth"] == 1), x["i"].cast("int")).otherwise(F.lit(-1)).alias("end"))))
    return F.when((at > 0) & (done["end"] >= 0), F.substring(rest, F.lit(1), done["end"] + 1))


def cleaned(text: Column) -> Column:
    """Trailing commas removed, Python literals and single quotes in JSON's spelling."""
    c = F.regexp_replace(text, r",\s*([}\]])", "$1")
    c = F.regexp_replace(c, r"(?<=[{,:\[]\s?)'|'(?=\s*[,:}\]])", '"')
    for a, b in (("True", "true"), ("False", "false"), ("None", "null")):
        c = F.regexp_replace(c, rf"(?<=[:\[,]\s?){a}(?=\s*[,}}\]])", b)
    return c


def recovered(text: Column) -> Column:
    """Fields of an object that was cut off: complete pairs, and the cut last string of a known field."""
    def field(name: str) -> Column:
        full = F.regexp_extract(text, rf'(?s)"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
        plain = F.regexp_extract(text, rf'"{name}"\s*:\s*(true|false|null|-?\d+(?:\.\d+)?)', 1)
        cut = F.regexp_extract(text, rf'(?s)"{name}"\s*:\s*"((?:[^"\\]|\\.)*)$', 1)
        return F.coalesce(F.nullif(full, F.lit("")), F.nullif(plain, F.lit("")), F.nullif(cut, F.lit(""))).alias(name)

    s = F.struct(*[field(f) for f in FIELDS])
    opened = F.length(F.regexp_replace(text, r"[^{]", "")) > F.length(F.regexp_replace(text, r"[^}]", ""))
    return F.when(opened & s["humorous"].isNotNull(), s)


def truth(value: Column) -> Column:
    """Boolean of a parsed value; null for anything unknown, never made up."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "1"), True).when(v.isin("false", "no", "0"), False).when(F.try_to_number(v, F.lit("999999")).isNotNull(), F.try_to_number(v, F.lit("999999")) != 0)


def repaired(text: Column) -> tuple[Column, Column]:
    """(struct of fields, name of the step that gave it); the first of direct, fenced, balanced, cleaned and recovered."""
    steps = [("direct", _object(text)), ("fenced", _object(fenced(text))), ("balanced", _object(balanced(text))), ("cleaned", _object(cleaned(F.coalesce(fenced(text), balanced(text), text)))), ("recovered", recovered(text))]
    how = F.lit("failed")
    for name, s in reversed(steps):
        how = F.when(s.isNotNull(), name).otherwise(how)
    return F.coalesce(*[s for _, s in steps]), how


def fused(p: Column, q: Column, text_class: Column, late: Column) -> tuple[Column, Column, Column]:
    """(humorous, confidence, method): probabilities override the text; nothing is decided after a timeout."""
    known = ~late & p.isNotNull() & q.isNotNull()
    humorous = F.when(known, p >= 0.5).when(~late, text_class)
    method = F.when(known, "probability").when(~late & text_class.isNotNull(), "text").otherwise("unavailable")
    return humorous, F.when(known, F.round(F.greatest(p, 1 - p), 6)), method


def dependency(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(value.isNull(), "Not analyzed").when(v.contains("high"), "High").when(v.contains("med"), "Medium").when(v.contains("low") | v.contains("none"), "Low").otherwise(F.initcap(v))


def placeholder(value: Column, default: str) -> Column:
    return F.when(value.isNull() | F.lower(F.trim(value)).isin("", "none", "null"), F.lit(default)).otherwise(F.trim(value))


def title(value: Column) -> Column:
    """Parts between slashes and commas, trimmed, in title case, joined by ' / '."""
    return F.array_join(F.filter(F.transform(F.split(value, "[/,]"), lambda x: F.initcap(F.trim(x))), lambda x: x != ""), " / ")


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.5, "Moderate").when(confidence.isNotNull(), "Low")


def route(humorous: Column, has_category: Column, context: Column, failed: Column) -> Column:
    """Route of a two-stage run: short_circuit_nonhumor, reuse_stage1, stage2 or stage2_fallback."""
    valid = F.coalesce((F.trim(context) != "") & ~context.contains(NO_CONTEXT), F.lit(False))
    short = F.coalesce(~humorous, F.lit(True)) & ~(has_category & valid)
    return F.when(short, "short_circuit_nonhumor").when(~valid, "reuse_stage1").when(F.coalesce(failed, F.lit(False)), "stage2_fallback").otherwise("stage2")
