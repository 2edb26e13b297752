"""Rule table: defaults, filters, id repair, deduplication, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import identifier, num_id, safe_string, strip

REQUIRED = ["article_id", "legal_subject", "condition", "effect", "condition_event", "effect_event"]
OPTIONAL = [
    "index", "article_title", "content", "causal_type", "condition_event_name", "effect_event_name", "normalization_metadata", "rule_text",
    "quality_status", "source_scope", "condition_event_original", "effect_event_original", "condition_event_modality", "effect_event_modality",
    "event_normalization_version",
]


def with_defaults(raw: DataFrame) -> DataFrame:
    """All rule columns as stripped strings ('' for missing) and ``row_pos``, the order of the rows."""
    if missing := [c for c in [*REQUIRED, "row_pos"] if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select("row_pos", *((safe_string(F.col(c)) if c in raw.columns else F.lit("")).alias(c) for c in REQUIRED + OPTIONAL))


def complete_rules(rules: DataFrame) -> DataFrame:
    return rules.where((F.col("condition_event") != "") & (F.col("effect_event") != ""))


def skipped(rules: DataFrame) -> DataFrame:
    """One row of counters: rules without an event, rules that are a loop."""
    gap = (F.col("condition_event") == "") | (F.col("effect_event") == "")
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(gap).alias("skipped_missing_norm"), F.count_if(~gap & (F.col("condition_event") == F.col("effect_event"))).alias("skipped_causal_self_loop"))


def with_rule_id(rules: DataFrame) -> DataFrame:
    """``rule_id``: the index, or the row's position + 1; later rows with the same one get _2, _3 and so on."""
    base = num_id(F.col("index"))
    base = F.when(base == "", (F.col("row_pos") + 1).cast("string")).otherwise(base)
    place = Window.partitionBy("base_id").orderBy("row_pos")
    out = rules.withColumn("base_id", base).withColumn("_n", F.row_number().over(place))
    return out.withColumn("rule_id", F.when(F.col("_n") == 1, F.col("base_id")).otherwise(F.concat_ws("_", "base_id", "_n"))).drop("_n")


def normalised(raw: DataFrame) -> DataFrame:
    """Rules ready for the graph: complete, with ids, article ids without .0, subject keys and event names."""
    rules = with_rule_id(complete_rules(with_defaults(raw)))
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    return rules.withColumns({
        "article_id": num_id(F.col("article_id")),
        "subject_norm": identifier(F.col("legal_subject")),
        "condition_event_name": pick("condition_event_name", "condition_event"),
        "effect_event_name": pick("effect_event_name", "effect_event"),
        "condition_event_original": pick("condition_event_original", "condition_event"),
        "effect_event_original": pick("effect_event_original", "effect_event"),
    })


def duplicate_ids(rules: DataFrame) -> DataFrame:
    """Ids that repair has made equal; expected to be empty."""
    return rules.groupBy("rule_id").count().where("count > 1")


def deduplicated(rules: DataFrame) -> DataFrame:
    """The first rule of each signature (article, subject, condition, effect; case and spaces aside), numbered anew from 1 within its article."""
    flat = lambda c: F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    keys = [F.col("article_id"), flat(F.col("legal_subject")), flat(F.col("condition")), flat(F.col("effect"))]
    first = rules.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_pos"))).where("_n = 1").drop("_n")
    return first.withColumn("article_index", F.row_number().over(Window.partitionBy("article_id").orderBy("row_pos")))


def valid_items(items: DataFrame) -> DataFrame:
    """Extracted rules that have both sides; a missing rule text is put together and ends with a stop."""
    c, e, s, t = (safe_string(F.col(x)) for x in ("condition", "effect", "legal_subject", "rule_text"))
    made = F.concat(F.when(s != "", F.concat(s, F.lit(": "))).otherwise(F.lit("")), c, F.lit(" → "), e)
    text = F.when(t != "", t).otherwise(made)
    text = F.when(text.rlike(r"[.?!]$"), text).otherwise(F.concat(text, F.lit(".")))
    return items.where((c != "") & (e != "")).withColumns({"condition": c, "effect": e, "legal_subject": s, "rule_text": text})


def rule_key(index, article_id, condition, effect):
    """A rule's sha-256 key. Absent values are '', nulls the word None."""
    part = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", part(index), part(article_id), part(condition), part(effect)), 256)


def merged(raw: DataFrame, existing: DataFrame, key: str = "rule_key") -> DataFrame:
    """Rows of ``raw``, each replaced by the existing row of its key if there is one."""
    columns = [c for c in raw.columns if c != key]
    have = existing.select(F.col(key).alias("_k"), F.lit(True).alias("_have"), *(F.col(c).alias(f"_e_{c}") for c in columns))
    out = raw.join(have, F.col(key) == F.col("_k"), "left")
    return out.select(key, *(F.when(F.col("_have"), F.col(f"_e_{c}")).otherwise(F.col(c)).alias(c) for c in columns), F.coalesce("_have", F.lit(False)).alias("resumed"))


def replaced(existing: DataFrame, new: DataFrame, by: str = "article_id") -> DataFrame:
    """Upsert: the existing rows of every group that ``new`` has go, then the union is deduplicated."""
    return deduplicated(existing.join(new.select(by).distinct(), by, "left_anti").unionByName(new))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resumed batch: what is not done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")
