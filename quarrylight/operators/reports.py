"""Reports over the crawl queue and over recognition results: one grouped pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.urls import format_bucket

from .state import LOADED, PROBLEM, TERMINAL

FORMATS = ("html", "pdf", "office", "text", "archive", "other")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def queue_summary(rows: DataFrame, completed: tuple[str, ...], pending: tuple[str, ...], problems: tuple[str, ...]) -> DataFrame:
    part = lambda s: F.count_if(F.col("status").isin(*s))
    return rows.agg(F.count(F.lit(1)).alias("total"), part(completed).alias("completed"), part(pending).alias("pending"), part(("processing",)).alias("processing"), part(problems).alias("problems"))


def pipeline_status(state: DataFrame) -> DataFrame:
    """A row for each format and one for all (format null): five counters, the loaded share and the last index time."""
    row = state.withColumn("format", format_bucket(F.col("url"), F.col("doc_type")))
    terminal = F.col("status").isin(*TERMINAL) | (F.col("is_active") == 0)
    loaded, working = F.col("status").isin(*LOADED) & ~terminal, (F.col("status") == "processing") & ~terminal
    flags = row.select("format", "last_indexed_at", loaded.alias("l"), terminal.alias("t"), working.alias("p"), F.col("status").isin(*PROBLEM).alias("b"))
    counters = [F.count(F.lit(1)).alias("total"), F.count_if("l").alias("loaded"), F.count_if(~(F.col("l") | F.col("t") | F.col("p"))).alias("remaining"), F.count_if("p").alias("processing"), F.count_if("t").alias("terminal"), F.count_if("b").alias("problems"), F.max("last_indexed_at").alias("last_indexed_at")]
    both = flags.rollup("format").agg(*counters)  # both levels in one pass
    share = F.coalesce(F.bround(100 * F.try_divide(F.col("loaded"), F.col("total") - F.col("terminal")), 1), F.lit(0.0))
    return both.withColumn("percent", share)


def statistics(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(F.col("is_active") == 1, 1).otherwise(0)), F.lit(0)).alias("active"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), "id").alias("r")).select("r.*")


def samples(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each class."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def confidence(words: DataFrame, by: str) -> DataFrame:
    """Mean confidence, share below 60 and number of recognised words (conf not negative, text not blank)."""
    real = words.where((F.col("conf") >= 0) & (F.trim("text") != ""))
    return real.groupBy(by).agg(F.avg("conf").alias("mean"), F.avg((F.col("conf") < 60).cast("int")).alias("low"), F.count(F.lit(1)).alias("words"))


def page_confidence(pages: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """`confidence` with a row for each page: one without words has (0, 1, 0)."""
    found = pages.select(by).distinct().join(confidence(words, by), by, "left")
    return found.select(by, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("low", F.lit(1.0)).alias("low"), F.coalesce("words", F.lit(0).cast("long")).alias("words"))


def document_confidence(pages: DataFrame, by: str) -> DataFrame:
    """Mean of the measured page confidences; null, never 0, if none was measured."""
    return pages.groupBy(by).agg(F.bround(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 2).alias("confidence"))


def slice_progress(tasks: DataFrame) -> DataFrame:
    """done and total over the slices of a task that have started."""
    real = F.filter("slices", lambda s: s.isNotNull())
    add = lambda k: F.aggregate(real, F.lit(0).cast("long"), lambda a, s: a + s[k])
    return tasks.withColumns({"done": add("done"), "total": add("total")})


def best_attempt(attempts: DataFrame, by: str, floor: float = 65.0) -> DataFrame:
    """The ladder's choice: the first attempt at or above the floor ends it; among those made the best confidence wins, ties to the earlier."""
    order = Window.partitionBy(by).orderBy("step")
    passed = F.max((F.col("confidence") >= floor).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    made = attempts.withColumn("_p", F.coalesce(passed, F.lit(0))).where("_p = 0").drop("_p")
    return made.groupBy(by).agg(F.max_by("step", F.struct("confidence", -F.col("step"))).alias("step"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("attempts"))


def render_dpi(native, width_pt, height_pt, minimum: int = 200, maximum: int = 400, pixels: int = 8_000_000):
    """Native resolution within bounds and within a budget of pixels."""
    fit = F.floor(F.sqrt(F.lit(float(pixels)) / ((width_pt / 72) * (height_pt / 72))))
    return F.least(F.greatest(F.coalesce(native, F.lit(minimum)), F.lit(minimum)), F.lit(maximum), F.greatest(fit, F.lit(72))).cast("int")


def manifest_differences(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem: missing, unexpected or mismatch, of two tables (path, sha256)."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("got")), "path", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("got"), "mismatch")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def expired(archives: DataFrame, keep: int) -> DataFrame:
    """Archives (name) beyond the newest `keep`: older than the last of those, which are found by a bounded sort."""
    last = archives.orderBy(F.desc("name")).limit(keep).agg(F.min("name").alias("_last"), F.count(F.lit(1)).alias("_kept"))
    return archives.crossJoin(F.broadcast(last)).where(F.when(F.col("_kept") < keep, False).otherwise(F.col("name") < F.col("_last"))).drop("_last", "_kept")


def page_decision(blank, native_readable, ocr_text, ocr_readable, engine=None):
    """Which text a page gets: blank, ocr, native or unreadable; without an engine the native text decides."""
    native = F.when(native_readable, "native")
    found = F.when(blank, F.coalesce(native, F.lit("blank"))).when((F.coalesce(ocr_text, F.lit("")) != "") & ocr_readable, "ocr").otherwise(F.coalesce(native, F.lit("unreadable")))
    return found if engine is None else F.when(~engine, F.coalesce(native, F.lit("unreadable"))).otherwise(found)


def best_rotation(attempts: DataFrame, by: str, enough: int = 78) -> DataFrame:
    """The former rule: attempts until one scores enough; then acceptable before not, higher score, longer text, earlier."""
    order = Window.partitionBy(by).orderBy("step")
    done = F.max((F.col("score") >= enough).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    made = attempts.withColumn("_d", F.coalesce(done, F.lit(0))).where("_d = 0")
    return made.groupBy(by).agg(F.max_by("step", F.struct("acceptable", "score", "length", -F.col("step"))).alias("step"))


def page_order(n: int, first: tuple[int, ...] = ()) -> list[int]:
    """Pages 1 to n, the wanted ones first."""
    wanted = [p for p in dict.fromkeys(first) if 1 <= p <= n]
    return wanted + [p for p in range(1, n + 1) if p not in wanted]
