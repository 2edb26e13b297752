"""Line deduplication by winnowing over line hashes.

In every window of ``run`` lines the line with the smallest hash is selected, so any repeated run of that
many lines is guaranteed to share one. A line of ``alone`` or more characters is a run by itself and so
always selected. The selected lines are the fingerprints; there is a row for each position of one, with the
hashes of the ``run`` - 1 lines before and after it. Positions whose fingerprint occurs once are dropped.
The others are joined with the first position in the corpus that has the same fingerprint and the same
neighbours, for each way in which a run can lie around it, and long lines with their first position whatever
its neighbours. Every match is then extended both ways, line by line, as far as the two places agree: within
a longer common run fingerprints lie at most ``run`` lines apart, so their extensions overlap and cover it.
The later of the two places is deleted; adjacent and overlapping extensions are merged into maximal runs.

Groups (a fingerprint, a fingerprint with neighbours) are aggregated before they meet the positions again,
and those joins have a unique side, so a line in a third of all documents is split like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from causeway.llm.common import documents, sortable_id, text_or_empty, without_reserved, written

ALONE = 40  # characters of a line that is deleted between other neighbours too


def _positions(docs: DataFrame, text: str, doc_id: str, run: int, alone: int | None) -> DataFrame:
    """A row for each fingerprint's position: its place, its hash, and those of the lines before (nearest first) and after it.

    The last bit of a hash tells that the line is blank, the one before that it has ``alone`` or more characters.
    """
    lines = docs.select(sortable_id(doc_id).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_t"), F.split(text_or_empty(text), "\n").alias("_lines"))
    long = "false" if alone is None else f"length(trim(x)) >= {max(alone, 1)}"
    blank = "length(translate(x, ' ', '')) = 0"
    hashes = F.expr(f"transform(_lines, x -> (xxhash64(x) & -4L) | cast(if({long}, 2, 0) + if({blank}, 1, 0) AS bigint))")
    lines = lines.select("_id", "_t", hashes.alias("_h"))
    minima = f"transform(sequence(0, size(_h) - {run}), s -> s + array_position(slice(_h, s + 1, {run}), array_min(slice(_h, s + 1, {run}))) - 1)"
    minima = f"if(size(_h) >= {run}, {minima}, cast(array() AS array<bigint>))"
    longs = "filter(transform(_h, (h, i) -> if(h & 2 = 2, cast(i AS bigint), -1L)), i -> i >= 0)"
    at = lines.select("_id", "_t", "_h", F.explode(F.expr(f"array_union({minima}, {longs})")).alias("_i"))
    before = f"reverse(slice(_h, cast(greatest(_i - {run - 1}, 0) + 1 AS int), cast(least(_i, {run - 1}) AS int)))"
    return at.select("_id", "_t", F.col("_i").cast("long").alias("_i"), F.expr("_h[cast(_i AS int)]").alias("_fp"), F.expr(before).alias("_back"), F.expr(f"slice(_h, cast(_i + 2 AS int), {run - 1})").alias("_fore"))


def _common(a: str, b: str) -> Column:
    """How many leading elements of two arrays agree."""
    n = f"least(size({a}), size({b}))"
    return F.expr(f"if({n} > 0, size(filter(sequence(1, {n}), n -> slice({a}, 1, n) = slice({b}, 1, n))), 0)")


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = 2, alone: int | None = ALONE) -> DataFrame:
    """(_id, _t, runs): per document with repeats, its maximal runs of repeated lines as sorted structs (a, b) of line numbers from 0, both included."""
    positions = written(_positions(docs, text, doc_id, run, alone), "line-positions")
    shared = positions.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_fp").alias("_fp_s"))
    # Groups are written before they are joined: with an exchange on either side AQE can split a hot one.
    kept = positions.join(written(shared, "line-fingerprints"), F.col("_fp") == F.col("_fp_s"), "left_semi")
    ways = F.expr(f"filter(transform(sequence(0, {run - 1}), o -> struct(o AS o, concat(slice(_back, 1, o), array(_fp), slice(_fore, 1, {run - 1} - o)) AS w)), x -> size(x.w) = {run} AND exists(x.w, h -> h % 2 = 0))")
    # A long line meets its first position by itself, as the way -1.
    single = F.expr("if(_fp & 2 = 2, array(struct(-1 AS o, array(_fp) AS w)), array())")
    keyed = kept.withColumn("_way", F.explode(F.concat(ways, single))).withColumns({"_o": F.col("_way.o"), "_w": F.xxhash64("_way.w")}).drop("_way")
    here = F.struct("_id", "_t", "_i")
    first = keyed.groupBy("_fp", "_o", "_w").agg(F.min(F.struct("_id", "_t", "_i", "_back", "_fore")).alias("_q"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = written(first.select(F.col("_fp").alias("_f1"), F.col("_o").alias("_f2"), F.col("_w").alias("_f3"), F.struct("_q._id", "_q._t", "_q._i").alias("_at"), F.col("_q._back").alias("_qb"), F.col("_q._fore").alias("_qf")), "line-firsts")
    later = keyed.join(first, (F.col("_fp") == F.col("_f1")) & (F.col("_o") == F.col("_f2")) & (F.col("_w") == F.col("_f3"))).where(here > F.col("_at"))
    later = later.withColumns({"_up": _common("_back", "_qb"), "_down": _common("_fore", "_qf")}).where((F.col("_up") + F.col("_down") + 1 >= run) | (F.col("_o") < 0))
    # The extension as its windows of ``run`` lines, those of blank lines alone left out, and the long line.
    later = later.withColumn("_ext", F.expr("concat(reverse(slice(_back, 1, _up)), array(_fp), slice(_fore, 1, _down))"))
    windows = f"if(size(_ext) >= {run}, filter(sequence(0, size(_ext) - {run}), s -> exists(slice(_ext, s + 1, {run}), h -> h % 2 = 0)), cast(array() AS array<int>))"
    gone = F.expr(f"concat(transform({windows}, s -> struct(_i - _up + s AS a, _i - _up + s + {run - 1} AS b)), if(_o < 0, array(struct(_i AS a, _i AS b)), array()))")
    later = later.select("_id", "_t", F.explode(gone).alias("_gone")).select("_id", "_t", "_gone.a", "_gone.b")
    place = Window.partitionBy("_id", "_t").orderBy("a", "b")
    reached = F.max("b").over(place.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("_new", (F.col("a") > F.coalesce(reached, F.lit(-2)) + 1).cast("int"))
    later = later.withColumn("_run", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy("_id", "_t", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("_id", "_t").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = 2, alone: int | None = ALONE) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_removed, runs (deleted line numbers) and kept_text.

    A run of ``run`` or more lines that also starts earlier, in a document with a smaller id or higher up
    in the same one, is deleted, and so is a line of ``alone`` or more characters (without blanks at its ends;
    None: no single line) that also stands earlier, whatever lines are next to it. Runs are judged on the
    input, not on what is left. A run of blank lines alone is none. Lines end at "\\n" only and are compared whole. A null text counts as empty: one empty
    line, nothing deleted. A null id sorts last. Rows that repeat an id and its text are one place and
    share their result; rows that share an id with other texts are ordered by a hash of the text. Columns
    of ``docs`` that clash with the results are replaced, those that begin with an underscore dropped.
    """
    docs = without_reserved(docs)
    runs = repeated_runs(docs, text, doc_id, run, alone).withColumnsRenamed({"_id": "_rid", "_t": "_rt", "runs": "_runs"})
    keyed = docs.withColumns({"_id": sortable_id(doc_id), "_t": F.xxhash64(text_or_empty(text))})
    out = keyed.join(runs, (F.col("_id") == F.col("_rid")) & (F.col("_t") == F.col("_rt")), "left")
    out = out.withColumn("_lines", F.split(text_or_empty(text), "\n")).withColumn("_n", F.size("_lines").cast("long"))
    pieces = F.expr("""flatten(transform(sequence(0, size(_runs)), k -> slice(_lines,
        cast(if(k = 0, 0, _runs[k - 1].b + 1) + 1 as int),
        cast(if(k = size(_runs), _n, _runs[least(k, size(_runs) - 1)].a) - if(k = 0, 0, _runs[k - 1].b + 1) as int))))""")
    out = out.withColumns({
        "n_lines": F.col("_n"),
        "n_removed": F.coalesce(F.expr("aggregate(_runs, 0L, (s, r) -> s + r.b - r.a + 1)"), F.lit(0).cast("long")),
        "runs": F.coalesce("_runs", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)")),
        "kept_text": F.when(F.col("_runs").isNull(), text_or_empty(text)).otherwise(F.array_join(pieces, "\n")),
    })
    return out.drop("_id", "_t", "_rid", "_rt", "_runs", "_lines", "_n")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, s, array_to_string(list_slice(lines, s + 1, s + 2), chr(10)) AS win
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 1)) AS s FROM d)
), f AS (
  SELECT win, min(ROW(doc_id, s)) AS first FROM w WHERE length(translate(win, ' ' || chr(10), '')) > 0 GROUP BY win
), hit AS (
  SELECT w.doc_id, w.s FROM w JOIN f USING (win) WHERE ROW(w.doc_id, w.s) > f.first
), l AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS j, unnest(lines) AS line FROM d
), single AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) AS nth FROM l WHERE length(trim(line)) >= 40
), gone AS (
  SELECT doc_id, unnest([s, s + 1]) AS j FROM hit UNION SELECT doc_id, j FROM single WHERE nth > 1
), runs AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p.j IS NULL) AS n_runs
  FROM gone g LEFT JOIN gone p ON p.doc_id = g.doc_id AND p.j = g.j - 1 GROUP BY g.doc_id
), left_over AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.j) AS t
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.j = l.j WHERE g.j IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       sha256(coalesce(left_over.t, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
