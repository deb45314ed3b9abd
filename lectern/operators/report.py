"""Plans, results and acceptance of benchmark runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_number, table_cell, trimmed, utf16_length
from .quantiles import medians

METRICS = ("capture_ms", "model_ms", "render_ms", "chunk_count", "source_bytes", "output_bytes", "image_count")
FORMATS = ("txt", "md", "pdf")


@dataclass(frozen=True)
class Rubric:
    """Most points of each criterion, and what a benchmark has to reach."""

    criteria: dict[str, float] = field(default_factory=lambda: {"fidelity": 35, "selection": 25, "format_compliance": 25, "coherence": 10, "reliability": 5})
    median_score: float = 85
    least_score: float = 70
    violations: int = 0
    defects: int = 0
    median_ms: dict[str, float] = field(default_factory=lambda: {"txt": 120_000, "md": 120_000, "pdf": 180_000})
    capture_render_ms: float = 15_000
    model_ms: float = 240_000


def nothing_of(rows: DataFrame, what: str) -> None:
    """Raise if there are rows."""
    found = rows.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def unknown(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Those of ``ids`` that are not ``known``."""
    return ids.join(known.select(key), key, "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def plan(articles: DataFrame, formats: list[str] | None = None, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """run_id, ordinal, place and the columns of (article_id, ordinal, ...): each article in each format, in order.

    ids act as a set and must be known; formats that are given twice are planned twice.
    """
    if ids:
        asked = articles.sparkSession.createDataFrame([(i,) for i in ids], "article_id string")
        nothing_of(unknown(asked, articles.withColumn("article_id", F.col("article_id").cast("string")), "article_id"), "unknown article")
        articles = articles.where(F.col("article_id").cast("string").isin(*ids))
    runs = articles.select("*", F.posexplode(F.array(*map(F.lit, formats or FORMATS))).alias("place", "format"))
    runs = runs.withColumn("run_id", F.concat(F.col("article_id").cast("string"), F.lit(":"), F.col("format")))
    return runs.orderBy("ordinal", "article_id", "place").limit(limit) if limit else runs


def failure(timed_out: Column, spawn_error: Column, exit_code: Column, output_bytes: Column) -> Column:
    """Why a run failed, the first reason that holds; null if it did not."""
    return (
        F.when(timed_out, "outer_timeout")
        .when(spawn_error, "spawn_error")
        .when(F.coalesce(exit_code, F.lit(-1)) != 0, F.concat(F.lit("process_exit_"), F.coalesce(exit_code.cast("string"), F.lit("unknown"))))
        .when(output_bytes.isNull(), "missing_output")
        .when(output_bytes == 0, "empty_output")
    )


def completed(runs: DataFrame) -> DataFrame:
    """Runs with status and failure of (run_id, timed_out, spawn_error, exit_code, file_bytes, metrics...); metrics cleaned."""
    why = failure(F.col("timed_out"), F.col("spawn_error"), F.col("exit_code"), F.col("file_bytes"))
    made = runs.withColumns({m: clean_number(F.col(m).cast("double")) for m in METRICS}).withColumn("failure", why)
    return made.withColumns({"output_bytes": F.coalesce("output_bytes", F.col("file_bytes").cast("double")), "status": F.when(why.isNull(), "success").otherwise("failure")})


def merged_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state with the runs just done: one row for each run_id, attempts counted up."""
    columns = [c for c in state.columns if c not in ("run_id", "attempts")]
    old = state.select("run_id", F.struct(*columns).alias("old"), F.col("attempts").alias("before"))
    new = done.select("run_id", F.struct(*columns).alias("new"))
    both = old.join(new, "run_id", "full_outer")
    use = F.coalesce("new", "old")
    return both.select("run_id", (F.coalesce("before", F.lit(0)) + F.when(F.col("new").isNotNull(), 1).otherwise(0)).alias("attempts"), *[use[c].alias(c) for c in columns])


def pending(planned: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Planned runs without a success whose output is not empty; all if forced."""
    if force:
        return planned
    done = state.where("status = 'success' and coalesce(file_bytes, 0) > 0").select("run_id")
    return planned.join(done, "run_id", "left_anti")


def score_total(rubric: Rubric) -> Column:
    """The sum of all criteria; null if one is missing."""
    total = F.lit(0.0)
    for c in rubric.criteria:
        total = total + F.col(c).cast("double")
    return total


def score_errors(scores: DataFrame, rubric: Rubric) -> DataFrame:
    """run_id, error of scores beyond their criterion, or with notes over 500 characters."""
    bad = [F.when(~F.col(c).between(0, most), F.lit(f"{c} must be between 0 and {most:g}")) for c, most in rubric.criteria.items()]
    bad.append(F.when(utf16_length(F.col("notes")) > 500, F.lit("notes must be 500 characters or less")))
    return scores.select("run_id", F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("error"))


def report(planned: DataFrame, state: DataFrame, scores: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """Every planned run with its state and score, or what stands for none."""
    ran = state.select("run_id", "status", "attempts", "total_ms", *METRICS, "failure")
    judged = scores.select("run_id", score_total(rubric).alias("score"), "txt_violation", "pdf_defect", trimmed(F.col("notes")).alias("notes"))
    rows = planned.join(ran, "run_id", "left").join(judged, "run_id", "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("not_run")), "attempts": F.coalesce("attempts", F.lit(0)), "notes": F.coalesce("notes", F.lit(""))})


def checked_report(planned: DataFrame, state: DataFrame, scores: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """As ``report``; scores of unknown runs, twice given ones and those out of bounds are errors."""
    nothing_of(unknown(scores.select("run_id"), planned, "run_id"), "unknown score")
    nothing_of(duplicates(scores, "run_id"), "duplicate score")
    nothing_of(score_errors(scores, rubric), "score")
    return report(planned, state, scores, rubric)


def by_format(runs: DataFrame) -> DataFrame:
    """format, planned, successful, median_ms (of successes), median_score (of all that are scored), txt_violations, pdf_defects."""
    won = F.col("status") == "success"
    counts = runs.groupBy("format").agg(
        F.count("*").alias("planned"),
        F.count_if(won).alias("successful"),
        F.count_if((F.col("format") == "txt") & F.coalesce("txt_violation", F.lit(False))).alias("txt_violations"),
        F.count_if((F.col("format") == "pdf") & F.coalesce("pdf_defect", F.lit(False))).alias("pdf_defects"),
    )
    times = medians(runs.select("format", F.when(won, F.col("total_ms")).alias("median_ms")), ["format"], "median_ms")
    scores = medians(runs.select("format", F.col("score").alias("median_score")), ["format"], "median_score")
    same = lambda other: F.col("c.format").eqNullSafe(F.col(f"{other}.format"))
    met = counts.alias("c").join(times.alias("t"), same("t")).join(scores.alias("s"), same("s"))
    return met.select("c.format", "planned", "successful", "median_ms", "median_score", "txt_violations", "pdf_defects")


def all_of(holds: Column, among: Column | None = None) -> Column:
    """Whether it holds for every row (of those ``among``): null does not, no rows do."""
    held = F.coalesce(holds, F.lit(False))
    return F.coalesce(F.bool_and(held if among is None else F.when(among, held)), F.lit(True))


def summary(runs: DataFrame) -> DataFrame:
    """One row of counts."""
    won = F.col("status") == "success"
    return runs.agg(
        F.count("*").alias("planned"),
        F.count_if(won).alias("successful"),
        F.count_if(F.col("status") == "failure").alias("failed"),
        F.count_if(F.col("status").isin("not_run", "running")).alias("not_run"),
        F.count_if(F.col("score").isNotNull()).alias("scored"),
        F.count_if(won & (F.col("capture_ms").isNull() | F.col("model_ms").isNull() | F.col("render_ms").isNull())).alias("untimed"),
    )


def acceptance(runs: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """One row: status (incomplete, fail or pass), the counts, and the single verdicts, null until every run has ended and is scored."""
    won, scored = F.col("status") == "success", F.col("score").isNotNull()
    whole = runs.agg(
        (all_of(F.col("status").isin("success", "failure")) & all_of(scored)).alias("complete"),
        all_of(won).alias("all_succeeded"),
        all_of(F.col("score") >= rubric.least_score, scored).alias("least_score_pass"),
        all_of(F.col("capture_ms") + F.col("render_ms") <= rubric.capture_render_ms, won).alias("capture_render_pass"),
        all_of(F.col("model_ms") <= rubric.model_ms, won).alias("model_pass"),
    )
    limit = F.create_map(*[F.lit(x) for pair in rubric.median_ms.items() for x in pair])
    known = runs.sparkSession.createDataFrame([(f,) for f in rubric.median_ms], "format string")
    each = known.join(by_format(runs), "format", "left").agg(
        all_of(F.col("median_score") >= rubric.median_score).alias("score_medians_pass"),
        all_of(F.col("median_ms") <= F.try_element_at(limit, F.col("format"))).alias("runtime_pass"),
        F.sum(F.coalesce("txt_violations", F.lit(0))).alias("txt_violations"),
        F.sum(F.coalesce("pdf_defects", F.lit(0))).alias("pdf_defects"),
    )
    both = whole.crossJoin(each)  # one row each
    verdicts = ("all_succeeded", "score_medians_pass", "least_score_pass", "runtime_pass", "capture_render_pass", "model_pass")
    ok = (F.col("txt_violations") <= rubric.violations) & (F.col("pdf_defects") <= rubric.defects)
    for v in verdicts:
        ok = ok & F.col(v)
    status = F.when(~F.col("complete"), "incomplete").when(ok, "pass").otherwise("fail")
    return both.select(status.alias("status"), *[F.when(F.col("complete"), F.col(v)).alias(v) for v in verdicts], "txt_violations", "pdf_defects")


def markdown_rows(runs: DataFrame) -> DataFrame:
    """run_id, line: a table row of each run."""
    shown = ("article_id", "format", "status", "total_ms", "capture_ms", "model_ms", "render_ms", "score", "failure", "notes")
    cells = [table_cell(F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") if c.endswith("_ms") or c == "score" else F.col(c).cast("string")) for c in shown]
    return runs.select("run_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(runs: DataFrame, benchmark: str, generated: str, rubric: Rubric = Rubric()) -> DataFrame:
    """One row: the report as Markdown.  A report has a row for each run; runs are ordered by article and format."""
    head = "# Benchmark report\n\nGenerated: %s\n\n## Summary\n\n- Benchmark: %s\n- Status: %s\n- Planned: %d\n- Successful: %d\n- Failed: %d\n- Not run: %d\n- Scored: %d\n- Without phase times: %d\n\n## Runs\n\n| Article | Format | Status | Total ms | Capture ms | Model ms | Render ms | Score | Failure | Note |\n| --- | --- | --- | ---: | ---: | ---: | ---: | ---: | --- | --- |\n%s\n"
    lines = markdown_rows(runs).join(runs.select("run_id", "ordinal", "place"), "run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "place", "line"))).alias("l"))
    one = summary(runs).crossJoin(acceptance(runs, rubric).select("status")).crossJoin(lines)  # one row each
    return one.select(F.format_string(head, F.lit(generated), F.lit(benchmark), "status", "planned", "successful", "failed", "not_run", "scored", "untimed", F.array_join("l.line", "\n")).alias("report"))


def run_metrics(bundles: DataFrame, content: Column) -> DataFrame:
    """source_bytes, output_bytes and image_count of (sections, assets, image_count)."""
    size = F.aggregate("sections", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["content"]))
    return bundles.withColumns({"source_bytes": size, "output_bytes": F.octet_length(content).cast("long"), "image_count": F.coalesce(F.col("image_count"), F.size("assets")).cast("long")})


def latest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
