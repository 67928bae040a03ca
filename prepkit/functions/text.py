"""JSON extraction from model-reply text (J1, J2): plain column expressions.

First fenced block (optional ``json`` tag, any case); otherwise the greedy
span from the first ``{`` (``[``) to the last ``}`` (``]``); parsed with
``try_parse_json`` so malformed text gives NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE_OBJ = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"
_BARE_OBJ = r"(\{[\s\S]*\})"
_FENCE_LIST = r"(?i)```(?:json)?\s*(\[[\s\S]*?\])\s*```"
_BARE_LIST = r"(\[[\s\S]*\])"


def _pick(text: Column, fenced: str, bare: str) -> Column:
    f = F.trim(F.regexp_extract(text, fenced, 1))
    b = F.trim(F.regexp_extract(text, bare, 1))
    return F.coalesce(F.nullif(f, F.lit("")), F.nullif(b, F.lit("")))


def json_text(text: Column) -> Column:
    """J1 without parsing: the JSON object text a reply carries (or NULL)."""
    return _pick(text, _FENCE_OBJ, _BARE_OBJ)


def extract_json(text: Column) -> Column:
    """VARIANT of the JSON object in a reply; NULL when absent or malformed."""
    return F.try_parse_json(json_text(text))


def extract_json_list(text: Column) -> Column:
    """VARIANT of the JSON list in a reply; NULL when absent or malformed."""
    return F.try_parse_json(_pick(text, _FENCE_LIST, _BARE_LIST))
