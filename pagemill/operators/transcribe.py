"""Pages through validation, routing, recognition and stitching; failures are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..schemas import as_regions
from . import order, roles, validate

KEY = ["doc_id", "page_index"]


def select_pages(df: DataFrame, pages: tuple[int, ...] | None) -> DataFrame:
    """Rows of these pages; a plain predicate, so it reaches the scan."""
    return df if pages is None else df.where(F.col("page_index").isin(*pages))


def placeholder(rows: DataFrame, source: str) -> DataFrame:
    """A region for each failed page (page_width, page_height, failure_reason) that covers it."""
    return as_regions(rows.withColumns({"seq": F.lit(0), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("page_width"), "y1": F.col("page_height"), "text": F.lit(""), "role": F.lit("failure_placeholder"), "source": F.lit(source)}))


def error_reason(kind: Column, message: Column) -> Column:
    """What an exception's class and message become: two memory errors by name, others as `Type:message`."""
    name = F.element_at(F.split(kind, r"\."), -1)
    torch = (F.element_at(F.split(kind, r"\."), 1) == "torch") & (name == "OutOfMemoryError")
    return F.when(torch, "cuda_out_of_memory").when(name == "MemoryError", "out_of_memory").otherwise(F.concat(name, F.lit(":"), F.coalesce(message, F.lit(""))))


def strictly(outcomes: DataFrame) -> DataFrame:
    """Fails the query at a failed page."""
    why = F.raise_error(F.concat(F.lit("page "), F.col("page_index") + 1, F.lit(" failed: "), F.coalesce("failure_reason", F.lit("unknown"))))
    return outcomes.withColumn("branch", F.when(F.col("branch") == "failed", why).otherwise(F.col("branch")))


def document_counts(outcomes: DataFrame) -> DataFrame:
    """doc_id, n_pages, ok_pages, failed_pages, all_failed."""
    failed = F.col("branch") == "failed"
    return outcomes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(~failed).alias("ok_pages"), F.count_if(failed).alias("failed_pages"), F.bool_and(failed).alias("all_failed"))


def exit_code(counts: Column | None = None, strict: bool = False) -> Column:
    """0 if any page came through, else 2; with strict 2 at any failed page."""
    bad = F.col("all_failed") | (F.col("failed_pages") > 0 if strict else F.lit(False))
    return F.when(bad, 2).otherwise(0)


@dataclass
class Result:
    outcomes: DataFrame
    regions: DataFrame
    validation: DataFrame

    def counts(self) -> DataFrame:
        return document_counts(self.outcomes)


Validator = Callable[[DataFrame, DataFrame], DataFrame]
#: (pages to recognise) -> regions in pixels, with page_width and page_height of the image, or rows with failure_reason
Recogniser = Callable[[DataFrame], DataFrame]


def post_process(regions: DataFrame, config: EngineConfig, reorder: Callable[..., DataFrame] = order.reorder) -> DataFrame:
    """Reading order, then roles. Needs page_width and page_height."""
    return roles.classify(reorder(regions, rtl=config.classify.rtl), config.classify)


def transcribe(pages: DataFrame, regions: DataFrame, config: EngineConfig | None = None, validator: Validator | None = None, recognise: Recogniser | None = None, reorder: Callable[..., DataFrame] = order.reorder) -> Result:
    """pages (page_width, page_height, has_text_layer) and native regions to ordered, labelled regions.

    Accepted pages keep their native text.  The others go to recognise; a page
    for which it gives no row, or none at all, is a failed one with a placeholder.
    """
    config = config or EngineConfig()
    pages, regions = select_pages(pages, config.pages), select_pages(regions, config.pages)
    check = validator or ((lambda p, r: validate.force_ml(p)) if config.force_ml else lambda p, r: validate.validate_pages(p, r, config.validator))
    validation = check(pages, regions)
    size = pages.select(*KEY, "page_width", "page_height")
    good, bad = validation.where("accept").select(*KEY), validation.where("NOT accept").select(*KEY, "reasons")
    native = post_process(regions.join(good, KEY, "left_semi").join(size, KEY), config, reorder)
    todo = size.join(bad, KEY)
    parts = [as_regions(native)]
    ok = good.withColumns({"branch": F.lit("native"), "failure_reason": F.lit(None).cast("string")})
    if recognise is None:
        lost = todo.withColumn("failure_reason", F.concat(F.lit("RuntimeError:ML branch needed for page "), F.col("page_index") + 1, F.lit(" but no layout_detector / ocr_transcriber wired")))
    else:
        seen = recognise(todo)
        if "failure_reason" not in seen.columns:
            seen = seen.withColumn("failure_reason", F.lit(None).cast("string"))
        errors = seen.where("failure_reason IS NOT NULL").groupBy(*KEY).agg(F.min("failure_reason").alias("failure_reason"))
        whole = seen.join(errors, KEY, "left_anti")
        done = whole.select(*KEY).distinct()
        lost = todo.join(done, KEY, "left_anti").join(errors, KEY, "left").withColumn("failure_reason", F.coalesce("failure_reason", F.lit("no_regions")))
        parts.append(as_regions(post_process(whole, config, reorder)))
        ok = ok.unionByName(done.withColumns({"branch": F.lit("ml"), "failure_reason": F.lit(None).cast("string")}))
    parts.append(placeholder(lost, "ocr"))
    outcomes = ok.unionByName(lost.select(*KEY, F.lit("failed").alias("branch"), "failure_reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Result(strictly(outcomes) if config.strict else outcomes, out, validation)
