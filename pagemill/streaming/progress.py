"""Progress events as a stream: parsing, one count a page, replay, and roll-ups that batch and stream share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import event_line

PHASES = ("validate", "rasterise", "layout", "ocr")


def parsed(raw: DataFrame) -> DataFrame:
    """(page, of, event, branch, reason, region, of_regions, role, phase, count) from (page_index, total, event).

    Events are phase:start:<phase>:<count>, start, rasterise, layout,
    region:<i>/<n>:<role>, complete:<branch>, failure:<reason>.
    """
    e = F.col("event")
    part = lambda pattern, k: F.nullif(F.regexp_extract(e, pattern, k), F.lit(""))
    region, phase = r"^region:(\d+)/(\d+):(.*)$", r"^phase:start:(\w+):(\d+)$"
    head = F.when(e.startswith("phase:start:"), "phase").otherwise(F.element_at(F.split(e, ":"), 1))
    return raw.select(
        *(c for c in raw.columns if c not in ("page_index", "total", "event")),
        (F.col("page_index") + 1).alias("page"), F.col("total").alias("of"), head.alias("event"),
        part(r"^complete:(.*)$", 1).alias("branch"), part(r"(?s)^failure:(.*)$", 1).alias("reason"),
        part(region, 1).cast("int").alias("region"), part(region, 2).cast("int").alias("of_regions"), part(region, 3).alias("role"),
        part(phase, 1).alias("phase"), part(phase, 2).cast("int").alias("count"),
    )


def line_events(events: DataFrame) -> DataFrame:
    """What a log shows: no phase headers, no rasterise."""
    return events.where(~F.col("event").isin("phase", "rasterise"))


def as_json(events: DataFrame) -> DataFrame:
    """One JSON object an event; region fields for region events alone, no time stamps."""
    plain = F.struct("page", "of", "event", "branch", "reason")
    whole = F.struct("page", "of", "event", "branch", "reason", "region", "of_regions", "role")
    keep = {"ignoreNullFields": "false"}
    return events.select(F.when(F.col("event") == "region", F.to_json(whole, keep)).otherwise(F.to_json(plain, keep)).alias("value"))


def as_text(events: DataFrame) -> DataFrame:
    return events.select(event_line().alias("value"))


def finished_pages(events: DataFrame, time: str | None = None, within: str = "1 day") -> DataFrame:
    """One row a page, whether it completes or fails, however often that is said.

    With time, the column of the events' times, a stream forgets a page once the watermark is `within` past it; without
    it a stream keeps every page as state.
    """
    done = events.where(F.col("event").isin("complete", "failure"))
    if time:
        return done.withWatermark(time, within).dropDuplicatesWithinWatermark(["doc_id", "page"]).select("doc_id", "page", "of", "event", "branch")
    return done.select("doc_id", "page", "of", "event", "branch").dropDuplicates(["doc_id", "page"])


def rollup(events: DataFrame) -> DataFrame:
    """doc_id, n_events, and pages that are finished, that came through and that failed, each page once; regions seen."""
    flag = lambda kind: F.max((F.col("event") == kind).cast("int"))
    page = events.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), flag("complete").alias("done"), flag("failure").alias("failed"), F.count_if(F.col("event") == "region").alias("regions"))
    return page.groupBy("doc_id").agg(
        F.sum("n").alias("n_events"), F.sum(F.greatest("done", "failed")).cast("long").alias("pages_finished"),
        F.sum("done").cast("long").alias("pages_done"), F.sum("failed").cast("long").alias("pages_failed"), F.sum("regions").alias("regions"),
    )


def bars(events: DataFrame) -> DataFrame:
    """(doc_id, finished, of, phase, phase_pages): pages that ended, each once, of all; the phase that began last, and its pages."""
    phase = F.max(F.when(F.col("event") == "phase", F.struct("event_id", "phase", "count")))
    page = events.groupBy("doc_id", "page").agg(F.max("of").alias("of"), F.max(F.col("event").isin("complete", "failure").cast("int")).alias("ended"), phase.alias("phase"))
    doc = page.groupBy("doc_id").agg(F.sum("ended").cast("long").alias("finished"), F.max("of").alias("of"), F.max("phase").alias("p"))
    return doc.select("doc_id", "finished", "of", F.col("p.phase").alias("phase"), F.col("p.count").alias("phase_pages"))


def after(events: DataFrame, last_id: Column | int) -> DataFrame:
    """Replay: what came after the event of this id."""
    return events.where(F.col("event_id") > last_id)


def resumable(pages: DataFrame, finished: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index) still to do."""
    done = finished.select("doc_id", (F.col("page") - 1).alias("page_index"))
    return pages.join(done, ["doc_id", "page_index"], "left_anti")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Event files (JSON lines of doc_id, page_index, total, event) as they come."""
    raw = spark.readStream.schema("doc_id string, event_id long, page_index int, total int, event string").json(folder)
    return parsed(raw)


def run_available(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Takes up what is new since the checkpoint, appends one row a finished page to Parquet, and ends."""
    query = finished_pages(stream(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def outcome_events(outcomes: DataFrame) -> DataFrame:
    """The start and end events of a batch run's pages."""
    of = F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("int")
    end = F.when(F.col("branch") == "failed", F.concat(F.lit("failure:"), F.coalesce("failure_reason", F.lit("unknown")))).otherwise(F.concat(F.lit("complete:"), F.col("branch")))
    sized = outcomes.withColumn("total", of)
    return sized.select("doc_id", "page_index", "total", F.explode(F.array(F.lit("start"), end)).alias("event"))


