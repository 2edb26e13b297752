"""Text normalisation as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without Unicode white space at the ends; trim() knows the plain space only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def safe_string(x: Column) -> Column:
    return F.coalesce(strip(x.cast("string")), F.lit(""))


def safe_float(x: Column, default: float = 0.0) -> Column:
    """What is no finite number is the default."""
    v = F.expr("double('NaN')") if x is None else x.cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def safe_int(x: Column, default: int = 0) -> Column:
    """Truncates toward zero; what is no finite number is the default."""
    v = x.cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v.try_cast("bigint"))


def safe_bool(x: Column) -> Column:
    return F.lower(safe_string(x)).isin("true", "1", "yes", "y")


def tri_bool(x: Column) -> Column:
    """True, false or null; knows words of either language."""
    v = F.lower(strip_accents(safe_string(x)))
    return F.when(v.isin("true", "1", "yes", "y", "co"), True).when(v.isin("false", "0", "no", "n", "khong"), False)


@cache
def _accent_map() -> tuple[str, str]:
    """Characters whose decomposition without marks is a single character, and that character."""
    source, target = ["Đ", "đ"], ["D", "d"]
    for code in range(0x80, min(sys.maxunicode, 0xFFFF)):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) == "Mn":
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and c not in source:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, *_accent_map()), r"\p{Mn}", "")


def identifier(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(strip_accents(safe_string(x))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def event_identifier(x: Column) -> Column:
    return identifier(F.regexp_replace(F.upper(safe_string(x)), "^EVENT::", ""))


def match_key(x: Column) -> Column:
    low = strip_accents(F.lower(safe_string(x)))
    return strip(F.regexp_replace(F.regexp_replace(low, r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+", " "))


def slug(x: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.replace(match_key(x), F.lit(" "), F.lit("_")), "_+", "_"), "^_+|_+$", "")
    return F.when(made == "", F.lit("su_kien")).otherwise(made)


def num_id(x: Column) -> Column:
    return F.regexp_replace(safe_string(x), r"^(\d+)\.0$", "$1")


def text_v6(x: Column) -> Column:
    """Lower case, without quotes, other punctuation as spaces; accents stay."""
    low = strip(F.lower(F.coalesce(x.cast("string"), F.lit(""))))
    low = F.regexp_replace(low, "[“”\"`]", "")
    low = F.regexp_replace(low, r"(?U)[^\wÀ-ỹĐđ\s]", " ")
    return strip(F.regexp_replace(low, r"(?U)\s+", " "))


def text_v7(x: Column) -> Column:
    """Lower case, without accents, punctuation and underscores as spaces."""
    low = F.lower(strip_accents(safe_string(x)))
    return strip(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s]|_", " "), r"(?U)\s+", " "))


def tokens_v6(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x.cast("string"), F.lit(""))), F.lit("([0-9A-Za-zÀ-ỹĐđ]+(?:['’-][0-9A-Za-zÀ-ỹĐđ]+)?)"), 1)


def tokens_v7(x: Column) -> Column:
    return F.filter(F.split(text_v7(x), " "), lambda t: t != "")


def split_csv(x: Column) -> Column:
    return F.filter(F.transform(F.split(safe_string(x), ","), strip), lambda t: t != "")


def ensure_list(x: Column) -> Column:
    """A JSON list, or else values parted by commas."""
    v = safe_string(x)
    parsed = F.from_json(v, "array<string>")
    cleaned = F.filter(F.transform(parsed, safe_string), lambda t: t != "")
    return F.when(v.startswith("[") & parsed.isNotNull(), cleaned).otherwise(split_csv(v))


def ordered_distinct(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(x, safe_string), lambda t: t != ""))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# What a verdict may be called.
DECISIONS = {
    "YES": "SUPPORTED", "TRUE": "SUPPORTED", "KEEP": "SUPPORTED", "VERIFIED": "SUPPORTED",
    "ACCEPT": "SUPPORTED", "ACCEPTED": "SUPPORTED", "SUPPORTED": "SUPPORTED",
    "NO": "REJECT_DIRECT_CLAIM", "FALSE": "REJECT_DIRECT_CLAIM", "REJECT": "REJECT_DIRECT_CLAIM",
    "REJECTED": "REJECT_DIRECT_CLAIM", "CONTRADICTED": "REJECT_DIRECT_CLAIM",
    "NO_DIRECT_EDGE": "REJECT_DIRECT_CLAIM", "REJECT_DIRECT_CLAIM": "REJECT_DIRECT_CLAIM",
    "UNCERTAIN": "UNCERTAIN", "INSUFFICIENT": "UNCERTAIN", "NOT_ENOUGH_EVIDENCE": "UNCERTAIN",
}


def decision(x: Column) -> Column:
    key = F.upper(F.replace(text_v6(x), F.lit(" "), F.lit("_")))
    table = F.create_map(*[F.lit(v) for kv in DECISIONS.items() for v in kv])
    return F.coalesce(table[key], key)


def article_citations(values: Column, answer: Column) -> Column:
    """Citations "Điều N" from a list of labels and from the answer's text; other labels stay as they are."""
    one = lambda v: F.when(v.rlike(r"[Đđ]iều\s*[0-9]"), F.concat(F.lit("Điều "), F.regexp_extract(v, r"[Đđ]iều\s*([0-9]+(?:\.[0-9]+)?)", 1))).when(v.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(F.lit("Điều "), v)).otherwise(v)
    listed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: one(safe_string(v)))
    said = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"[Đđ]iều\s*([0-9]+(?:\.[0-9]+)?)"), 1), lambda v: F.concat(F.lit("Điều "), v))
    return F.array_distinct(F.filter(F.concat(listed, said), lambda v: v != ""))


def article_label(article_id: Column, title: Column) -> Column:
    i, t = safe_string(article_id), safe_string(title)
    return F.when((i != "") & (t != ""), F.concat(F.lit("Điều "), i, F.lit(" – "), t)).when(i != "", F.concat(F.lit("Điều "), i)).when(t != "", t).otherwise(F.lit("Không xác định điều luật"))


def truncated(x: Column, most: int) -> Column:
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most), r"(?U)\s+$", ""), F.lit("\n...[truncated]")))


def without_thoughts(x: Column) -> Column:
    """A model's reply without its reasoning block and code fences."""
    y = F.regexp_replace(x, r"(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(y, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def utc_now() -> Column:
    """This moment as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
