"""Queries over the event catalog (parts), and what models would answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.text import match_key
from causeway.operators import catalog as C
from causeway.operators import rules as R
from causeway.plans.bindings import RULES, raw_rules, table

_TYPES = ", ".join(f"'{t}'" for t in C.EVENT_TYPES)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(t) for t in C.EVENT_TYPES)), (F.col("p_size") % len(C.EVENT_TYPES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cat_pos"), F.concat(F.lit("part_"), "p_partkey").alias("event_id"), F.col("p_name").alias("event_name"), F.concat_ws(" ", "p_brand", "p_type").alias("description"), F.array(F.concat_ws(" ", "p_name", "p_brand")).alias("aliases"), kind.alias("event_type"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loud version of each part's name and brand, as a condition if the part is small and else as an effect."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("phrase_id"), F.concat(F.upper("p_name"), F.lit(" -- "), "p_brand", F.lit("!")).alias("phrase"), F.when(F.col("p_size") < 25, "condition").otherwise("effect").alias("role"), F.array().cast("array<string>").alias("excluded"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that are no part's name: nations, regions and market segments."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("phrase")).union(table(spark, sf_dir, "region").select("r_name")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()
    return names.select(F.xxhash64("phrase").alias("phrase_id"), "phrase", F.lit("condition").alias("role"), F.array().cast("array<string>").alias("excluded"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model: the best candidate is taken for every phrase."""
    c = C.ranked_candidates(words(spark, sf_dir), catalog(spark, sf_dir))
    asked = c.where("rank = 1").select("phrase_id", F.lit("USE_EXISTING").alias("action"), F.col("event_id").alias("selected_event_id"))
    return C.decided(words(spark, sf_dir), C.alias_matches(words(spark, sf_dir), catalog(spark, sf_dir)), c, asked)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.alias_matches(phrases(spark, sf_dir), catalog(spark, sf_dir)).where("event_id IS NOT NULL")
    out = C.merged_catalog(catalog(spark, sf_dir), found.select("event_id", "phrase", F.col("phrase_id").alias("article_id"), F.col("phrase_id").alias("ord")))
    return out.select("event_id", F.array_join("names", "|").alias("names"), F.coalesce(F.array_join(F.col("source_article_ids").cast("array<string>"), ","), F.lit("")).alias("article_ids"), F.coalesce("n_occurrences", F.lit(0)).alias("n_occurrences"))


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = R.rule_key(F.col("row_pos"), F.col("article_id"), F.col("condition"), F.col("effect"))
    rows = R.with_defaults(raw_rules(spark, sf_dir)).withColumn("rule_key", key)
    done = rows.where("condition_event_modality = 'R'").select("rule_key", F.lit("done").alias("effect"), "row_pos")
    return R.merged(rows.select("rule_key", "effect", "row_pos"), done).drop("rule_key")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as models give them: thoughts, a fence, and a list of rules within an object."""
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('<think>{"k": 1}</think>\n```json\n{"note": "a } in a string", "rules": ['), "props", F.lit(', 7]}\n```')).alias("reply"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select("cat_pos", "event_type", F.explode(F.array(F.lit("condition"), F.lit("effect"), F.lit("other"))).alias("role"))
    return rows.select("cat_pos", "role", C.compatible(F.col("role"), F.col("event_type")).alias("fits"))


def rule_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phrases of a rule for each part. Conditions are names and brands, or types; effects are brands, and for some parts the condition once more."""
    k, name = F.col("p_partkey"), F.concat(F.upper("p_name"), F.lit(" -- "), "p_brand", F.lit("!"))
    condition = F.when(F.col("p_size") < 25, name).otherwise(F.col("p_type"))
    sides = F.array(F.struct(F.lit("condition").alias("role"), condition.alias("phrase"), F.lit(0).alias("o")), F.struct(F.lit("effect").alias("role"), F.when(k % 10 == 0, condition).otherwise(F.col("p_brand")).alias("phrase"), F.lit(1).alias("o")))
    rows = table(spark, sf_dir, "part").select(k, "p_size", F.explode(sides).alias("s"))
    return rows.select((k * 2 + F.col("s.o")).alias("phrase_id"), (k * 2 + F.col("s.o")).alias("ord"), "s.phrase", "s.role", k.alias("rule"), F.col("p_size").alias("article_id"), k.alias("rule_index"), F.array().cast("array<string>").alias("excluded"))


def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model: every seventh rule chooses the part before, every fifth names its new event by the brand."""
    text = lambda x: x.cast("string")
    rows = rule_phrases(spark, sf_dir)
    return rows.select("phrase_id", F.when(F.col("rule") % 7 == 0, "USE_EXISTING").otherwise("CREATE_NEW").alias("action"), F.when(F.col("rule") % 7 == 0, F.concat(F.lit("part_"), F.col("rule") - 1)).alias("selected_event_id"),
                       F.when(F.col("rule") % 5 == 0, F.concat(F.lit("Nhãn "), F.substring("phrase", 1, 6))).alias("event_name"), text(F.lit(None)).alias("description"), F.when(F.col("rule") % 3 == 0, "STATE").otherwise("unknown").alias("event_type"), text(F.lit(None)).alias("canonical_alias"))


def grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, asked, events = rule_phrases(spark, sf_dir), rule_decisions(spark, sf_dir), catalog(spark, sf_dir)
    # Only what was chosen is scored: the stand-in takes no other candidate.
    chosen = asked.where("selected_event_id IS NOT NULL").join(rows.select("phrase_id", "phrase"), "phrase_id").join(events.withColumn("_t", C.search_text()).select(F.col("event_id").alias("selected_event_id"), "_t"), "selected_event_id")
    scored = chosen.select("phrase_id", F.col("selected_event_id").alias("event_id"), F.round(C.lexical(match_key(F.col("phrase")), match_key(F.col("_t"))), 6).alias("score"))
    return C.grown_catalog(rows, events, asked, scored, min_score=0.3)


QUERIES = {
    "alias_match": lambda s, d: C.alias_matches(phrases(s, d), catalog(s, d)).select("phrase_id", "event_id"),
    "role_filter": roles,
    "candidate_rank": lambda s, d: C.ranked_candidates(words(s, d), catalog(s, d)),
    "catalog_decisions": decisions,
    "catalog_create": lambda s, d: grown(s, d)[0],
    "catalog_grown": lambda s, d: grown(s, d)[1].select("cat_pos", "event_id", "event_name", "event_type", "description", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.col("source_article_ids").cast("array<string>"), ",").alias("article_ids"), F.size("occurrences").alias("n_occurrences"), "made_at"),
    "catalog_stats": lambda s, d: C.catalog_statistics(catalog(s, d), grown(s, d)[1]),
    "catalog_merge": merged,
    "json_rules_payload": lambda s, d: C.rules_from_replies(replies(s, d)).select("event_id", "pos", "rule_json"),
    "resume_merge": resumed,
}

_CAT = f"""cat AS (SELECT p_partkey AS cat_pos, 'part_' || p_partkey AS event_id, p_name, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) AS k1, trim(lower(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]+', ' ', 'g'))) AS k2, p_brand,
  [{_TYPES}][p_size % {len(C.EVENT_TYPES)} + 1] AS event_type FROM part), ph AS (SELECT p_partkey AS phrase_id, upper(p_name) || ' -- ' || p_brand || '!' AS phrase, CASE WHEN p_size < 25 THEN 'condition' ELSE 'effect' END AS role, trim(lower(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]+', ' ', 'g'))) AS k FROM part)"""
_FITS = "CASE role WHEN 'condition' THEN event_type IN ({c}) WHEN 'effect' THEN event_type IN ({e}) ELSE true END".format(**{k[0].lower(): ", ".join(f"'{t}'" for t in v) for k, v in C.ROLE_TYPES.items()})
_HIT = f"hit AS (SELECT phrase_id, phrase, arg_min(event_id, cat_pos) AS event_id FROM ph JOIN cat ON k IN (k1, k2) WHERE {_FITS} GROUP BY ALL)"

SQL = {
    "alias_match": f"WITH {_CAT}, {_HIT} SELECT p_partkey AS phrase_id, event_id FROM part LEFT JOIN hit ON phrase_id = p_partkey",
    "role_filter": f"WITH {_CAT}, r AS (SELECT cat_pos, event_type, unnest(['condition', 'effect', 'other']) AS role FROM cat) SELECT cat_pos, role, {_FITS} AS fits FROM r",
    "catalog_merge": f"""WITH {_CAT}, {_HIT} SELECT c.event_id, p_name || '|' || p_name || ' ' || p_brand AS names, coalesce(string_agg(phrase_id::VARCHAR, ',' ORDER BY phrase_id), '') AS article_ids, count(phrase_id) AS n_occurrences
      FROM cat c LEFT JOIN hit h ON h.event_id = c.event_id GROUP BY c.event_id, p_name, p_brand""",
    "json_rules_payload": "SELECT event_id, 0 AS pos, props AS rule_json FROM events",
    "resume_merge": f"WITH {RULES} SELECT row_pos, CASE WHEN condition_event_modality = 'R' THEN 'done' ELSE effect END AS effect, condition_event_modality = 'R' AS resumed FROM raw",
}
