"""Reading what models return: JSON inside prose or fences, missing fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, stripped


def _whole(text: Column) -> Column:
    return F.try_parse_json(text)


def from_free_text(text: Column) -> Column:
    """A VARIANT: the text as JSON, else what lies from its first ``{`` to its
    last ``}``; null if neither parses."""
    inside = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(_whole(text), _whole(F.nullif(inside, F.lit(""))))


def strip_fence(text: Column) -> Column:
    """Without a leading code fence line and all from the last fence."""
    body = F.regexp_replace(strip(text), r"(?s)^```[^\n]*\n", "")
    return F.when(strip(text).startswith("```"), strip(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""))).otherwise(strip(text))


def field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def has_field(v: Column, name: str) -> Column:
    """Whether a field is there, be it null."""
    return F.array_contains(F.map_keys(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), name)


RESPONSE = "candidates array<struct<content:struct<parts:array<struct<text:string,inlineData:struct<mimeType:string,data:string>,inline_data:struct<mimeType:string,mime_type:string,data:string>>>>>>, usageMetadata map<string,string>"


def response_parts(response: Column) -> Column:
    return F.get(F.from_json(response, RESPONSE)["candidates"], F.lit(0))["content"]["parts"]


def response_text(response: Column) -> Column:
    """Texts of the first candidate's parts, joined; null if there is none."""
    parts = response_parts(response)
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.nullif(F.array_join(texts, ""), F.lit(""))


def response_image(response: Column) -> Column:
    """``(mime, data, texts)`` of the last inline image, png if untyped."""
    parts = response_parts(response)
    images = F.transform(parts, lambda p: F.struct(
        F.coalesce(p["inlineData"]["mimeType"], p["inline_data"]["mimeType"], p["inline_data"]["mime_type"], F.lit("image/png")).alias("mime"),
        F.coalesce(p["inlineData"]["data"], p["inline_data"]["data"]).alias("data")))
    last = F.try_element_at(F.filter(images, lambda x: x["data"].isNotNull() & (x["data"] != "")), F.lit(-1))
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.when(last.isNotNull(), F.struct(last["mime"].alias("mime"), F.unbase64(last["data"]).alias("data"), texts.alias("texts")))


def usage(response: Column) -> Column:
    return F.from_json(response, RESPONSE)["usageMetadata"]


def coerce_bool(text: Column, default: Column) -> Column:
    t = F.lower(strip(text))
    return F.when(t.isin("true", "yes", "y", "1"), True).when(t.isin("false", "no", "n", "0", ""), False).otherwise(default)


def normalize_list(items: Column) -> Column:
    return stripped(F.coalesce(items, F.array().cast("array<string>")))


def override_text(v: Column, name: str, base: Column) -> Column:
    """A final answer's text field over the batch's: absent takes the batch's,
    a null reads ``None``, an empty text stays empty."""
    return F.when(~has_field(v, name), base).otherwise(F.coalesce(field(v, f"$.{name}", "string"), F.lit("None")))


def override_list(v: Column, name: str, base: Column) -> Column:
    """A final answer's list over the batch's; null, absent and empty take the
    batch's."""
    own = normalize_list(field(v, f"$.{name}", "array<string>"))
    return F.when(F.size(own) > 0, own).otherwise(base)


#: Repair modes and sides.
MODES = ("edge_completion", "square_and_level", "crowd_cleanup", "subject_deblur", "tonal_only")
SIDES = ("left", "right", "top", "bottom")


def validated_analysis(mode: Column, sides: Column) -> Column:
    """``(repair_mode, pad_sides)``: unknown modes only adjust tone, only edge
    completion pads, and neither on all four sides nor without left or right."""
    known = F.when(mode.isin(*MODES), mode).otherwise("tonal_only")
    valid = F.filter(F.coalesce(sides, F.array().cast("array<string>")), lambda s: s.isin(*SIDES))
    level = (known == "edge_completion") & ((F.size(valid) == 4) | ~(F.array_contains(valid, "left") | F.array_contains(valid, "right")))
    return F.struct(
        F.when(level, "square_and_level").otherwise(known).alias("repair_mode"),
        F.when((known == "edge_completion") & ~level, valid).otherwise(F.array().cast("array<string>")).alias("pad_sides"),
    )


def parse_analysis(text: Column) -> Column:
    """Validated repair plan from a model's text; unparsable: tone only."""
    v = _whole(strip_fence(text))
    plan = validated_analysis(field(v, "$.repair_mode", "string"), field(v, "$.pad_sides", "array<string>"))
    reason = F.when(v.isNull(), F.concat(F.lit("Failed to parse: "), F.substring(strip_fence(text), 1, 200))).otherwise(field(v, "$.reason", "string"))
    return F.struct(plan["repair_mode"].alias("repair_mode"), plan["pad_sides"].alias("pad_sides"), reason.alias("reason"))
