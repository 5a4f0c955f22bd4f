"""Reading what models answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paralex.functions.text import last_part, strip


def json_field(text: Column, key: str = "translation") -> Column:
    """A field of a JSON object as text; anything else (no object, no such key, null,
    single quotes, text around it) is the empty string."""
    whole = text.rlike(r"^\s*\{[\s\S]*\}\s*$")
    value = F.from_json(text, f"`{key}` string", {"allowSingleQuotes": "false"})[key]
    return F.coalesce(F.when(whole, value), F.lit(""))


def after_thinking(text: Column, marker: str = "</think>") -> Column:
    """What follows the last marker, stripped; the whole text if there is none."""
    return strip(last_part(text, marker))
