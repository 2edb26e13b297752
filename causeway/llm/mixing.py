"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic), where every value without a target of its own
falls into "*"; the number of cells is thus bounded by the targets given, whatever the corpus. The
cells are raked to the three marginals in turn, as windows within one partition, and the calibrated
share over the present share gives each cell's sampling probability. Documents meet the cells in a
broadcast join and are drawn by a hash of their id, the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, text_or_empty, without_reserved, written

REST = "*"
#: Production targets. documents has no topic column; its topic here is the form of the text by length.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.12, "src1": 0.06, "src2": 0.06, "src3": 0.06, "src4": 0.06, "src5": 0.06, "src6": 0.06, REST: 0.52},
    "lang": {"en": 0.46, "de": 0.18, "fr": 0.18, "es": 0.16, REST: 0.02},
    "topic": {"note": 0.05, "article": 0.55, "book": 0.40},
}
SWEEPS, SWEEPS_AT_ONCE = 12, 3
#: The share of the tokens that a cell keeps if it is as large as its calibrated share.
RATE = 0.6
#: More cells than this are not broadcast but joined by a shuffle.
MOST_CELLS = 100_000


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\n\\t\\r]+"), lambda x: x != "")).cast("long")


def form(tokens: Column) -> Column:
    return F.when(tokens < 100, "note").when(tokens < 2000, "article").otherwise("book")


def _class(value: Column, targets: dict[str, float]) -> Column:
    """The value if it has a target of its own, else "*"."""
    own = [x for x in targets if x != REST]
    return F.when(value.isin(own), value).otherwise(F.lit(REST)) if own else F.lit(REST)


def _start_sql(cells: str, targets: dict[str, dict[str, float]]) -> list[str]:
    """Common table expressions up to k0: the cells with their weights and goals, which add up to 1 over the values present."""
    dims = list(targets)
    goal = {d: f"CASE {d} " + " ".join(f"WHEN '{k}' THEN CAST({float(v)!r} AS DOUBLE)" for k, v in t.items()) + " ELSE CAST(0.0 AS DOUBLE) END" for d, t in targets.items()}
    return [
        f"c0 AS (SELECT {', '.join(dims)}, tokens, CAST(tokens AS DOUBLE) AS w, {', '.join(f'{g} AS g_{d}' for d, g in goal.items())} FROM {cells})",
        "c1 AS (SELECT *, " + ", ".join(f"count(*) OVER (PARTITION BY {d}) AS n_{d}" for d in dims) + " FROM c0)",
        "k0 AS (SELECT " + ", ".join(dims) + ", tokens, w, " + ", ".join(f"g_{d} / sum(g_{d} / n_{d}) OVER () AS g_{d}" for d in dims) + " FROM c1)",
    ]


def _sweeps_sql(dims: list[str], sweeps: int) -> list[str]:
    """Common table expressions k1 and so on: one for each dimension and sweep."""
    columns = f"{', '.join(dims)}, tokens, {', '.join(f'g_{x}' for x in dims)}"
    return [f"k{k + 1} AS (SELECT {columns}, w * g_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM k{k})" for k, d in enumerate(dims * sweeps)]


def _ratio_sql(dims: list[str], last: str) -> str:
    return f"SELECT {', '.join(dims)}, (w / sum(w) OVER ()) / (tokens / sum(CAST(tokens AS DOUBLE)) OVER ()) AS ratio FROM {last}"


def rake_sql(cells: str, targets: dict[str, dict[str, float]], sweeps: int) -> str:
    """SQL over the cells (one column for each dimension, and tokens) that returns them with ``ratio``, calibrated share over present share.

    Targets of values that no document has are left out and the others of that dimension scaled up.
    """
    dims = list(targets)
    return f"WITH {', '.join(_start_sql(cells, targets) + _sweeps_sql(dims, sweeps))} {_ratio_sql(dims, f'k{len(dims) * sweeps}')}"


def raked(cells: DataFrame, targets: dict[str, dict[str, float]], sweeps: int) -> DataFrame:
    """What ``rake_sql`` says, a few sweeps at a time: a plan of all sweeps nests as many windows and weighs on the driver.

    The cells are few (see ``mix``) and stay one partition, so no window needs a shuffle.
    """
    spark, dims = cells.sparkSession, list(targets)
    now = spark.sql(f"WITH {', '.join(_start_sql('{cells}', targets))} SELECT * FROM k0", cells=cells.coalesce(1))
    for at in range(0, sweeps, SWEEPS_AT_ONCE):
        now = written(now, "cells").coalesce(1)
        steps = _sweeps_sql(dims, min(SWEEPS_AT_ONCE, sweeps - at))
        now = spark.sql(f"WITH k0 AS (SELECT * FROM {{now}}), {', '.join(steps)} SELECT * FROM k{len(steps)}", now=now)
    return spark.sql(_ratio_sql(dims, "{now}"), now=written(now, "cells").coalesce(1))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, topic: Column | None = None, text: str = "text", doc_id: str = "doc_id", sweeps: int = SWEEPS, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` with n_tokens, topic, p (probability of being drawn) and kept.

    p = least(1, rate x calibrated share / present share): a cell too small for its target is taken
    whole. Values without a target, nulls among them, belong to "*"; if "*" has no target they weigh 0
    and go. Documents without tokens (null or empty) carry no weight: they go too, with p = 0. The draw
    depends on the id alone, so repeated rows share it; a null id draws like an empty one. ``topic`` is
    an expression over ``docs`` (default: the form of the text by its length). Columns that clash with
    the results are replaced, those that begin with an underscore dropped; an empty table stays empty.
    Texts of any length are counted whole. The cells are as many as the targets' values multiplied at most, whatever the corpus.
    """
    docs = without_reserved(docs)
    cells_most = 1
    for t in targets.values():
        cells_most *= len(t) + 1
    keyed = docs.withColumn("n_tokens", n_tokens(text_or_empty(text)))
    keyed = keyed.withColumn("topic", topic if topic is not None else form(F.col("n_tokens")))
    keyed = keyed.withColumns({f"_{d}": _class(F.col(d), t) for d, t in targets.items()})
    cells = keyed.where("n_tokens > 0").groupBy(*(F.col(f"_{d}").alias(d) for d in targets)).agg(F.sum("n_tokens").alias("tokens"))
    ratios = raked(cells, targets, sweeps)
    ratios = ratios.select(*(F.col(d).alias(f"_c_{d}") for d in targets), F.col("ratio").alias("_ratio"))
    ratios = F.broadcast(ratios) if cells_most <= MOST_CELLS else ratios
    on = [F.col(f"_{d}") == F.col(f"_c_{d}") for d in targets]
    out = keyed.join(ratios, on, "left")
    p = F.when(F.col("n_tokens") > 0, F.least(F.lit(1.0), F.lit(rate) * F.coalesce("_ratio", F.lit(0.0)))).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    out = out.withColumn("p", p).withColumn("kept", draw < F.col("p"))
    return out.drop("_ratio", *(f"_{d}" for d in targets), *(f"_c_{d}" for d in targets))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"), "kept")


def mix_sql(docs: str, columns: str, only_kept: bool = False) -> str:
    """DuckDB SQL for ``mix`` with the production targets over the table ``docs``."""
    classes = ", ".join(f"CASE WHEN {d} IN ({', '.join(repr(x) for x in t if x != REST)}) THEN {d} ELSE '{REST}' END AS k_{d}" for d, t in TARGETS.items())
    raked = rake_sql("cells", TARGETS, SWEEPS).removeprefix("WITH ")
    steps, _, last = raked.rpartition(") SELECT ")
    return f"""
WITH m AS (
  SELECT *, CASE WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 2000 THEN 'article' ELSE 'book' END AS topic FROM (
    SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\n\\t\\r]+'))::BIGINT AS n_tokens FROM {docs})
), k AS (SELECT *, {classes} FROM m),
cells AS (
  SELECT k_source AS source, k_lang AS lang, k_topic AS topic, sum(n_tokens)::BIGINT AS tokens FROM k WHERE n_tokens > 0 GROUP BY ALL
), {steps}), r AS (SELECT {last}),
q AS (
  SELECT k.*, CASE WHEN n_tokens > 0 THEN least(1.0, {RATE} * coalesce(ratio, 0.0)) ELSE 0.0 END AS p,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM k LEFT JOIN r ON r.source = k_source AND r.lang = k_lang AND r.topic = k_topic
)
SELECT {columns} FROM q {"WHERE u < p" if only_kept else ""}
"""


OP4_SQL = mix_sql("documents", "doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, u < p AS kept")
