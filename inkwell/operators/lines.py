"""Recognised lines: S7, A3, A4, J10, W7."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import strip
from inkwell.operators.extract import NO_LINE_CONFIDENCE
from inkwell.session import cut_lineage, shuffles_dropped

# Smallest text layer, row band, pairing thresholds.
MIN_TEXT_LAYER = 50
ROW_BAND = 15.0
PAIR_IOU, PAIR_MIN_AREA = 0.35, 0.50
CELL = 64.0

_BLANKS = r"^\s*|\s*$"


def text_layer_report(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """Page, character and word counts, and whether recognition is needed.

    The full text is never assembled: lengths of the pages between the first
    and the last non-blank one, plus the blank-line joints, give its length.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    stats = pages.select(
        "doc_id", "page_num", F.length(t).alias("_len"), F.length(strip(t)).alias("_core"),
        (F.length(t) - F.length(F.ltrim(t, F.lit(" \t\n\r\x0b\x0c")))).alias("_lead"),
        (F.length(t) - F.length(F.rtrim(t, F.lit(" \t\n\r\x0b\x0c")))).alias("_trail"),
        F.when(strip(t) != "", F.size(F.split(strip(t), r"\s+"))).otherwise(0).alias("_words"),
    )
    filled = F.col("_core") > 0
    ends = stats.groupBy("doc_id").agg(
        F.min(F.when(filled, F.struct("page_num", "_lead"))).alias("_first"),
        F.max(F.when(filled, F.struct("page_num", "_trail"))).alias("_last"),
    )
    inside = stats.join(ends, "doc_id").withColumn(
        "_in", F.coalesce(F.col("page_num").between(F.col("_first.page_num"), F.col("_last.page_num")), F.lit(False))
    )
    out = inside.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("_words"), F.lit(0)).alias("words"),
        (
            F.sum(F.when(F.col("_in"), F.col("_len")).otherwise(0)) + F.greatest(F.count_if("_in") - 1, F.lit(0)) * 2
            - F.coalesce(F.max("_first._lead"), F.lit(0)) - F.coalesce(F.max("_last._trail"), F.lit(0))
        ).alias("characters"),
    )
    return out.withColumn("ocr_required", F.col("characters") < MIN_TEXT_LAYER)


def join_pages(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """Documents with their pages joined by a blank line.

    The result row holds the whole document by definition; use the report
    above where only counts are needed.
    """
    parts = F.array_sort(F.collect_list(F.struct("page_num", F.col(text).alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("full_text"))


def confidence_rollup(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: page means of lines, document means of page means, both to 4 places.

    Decimal sums keep the result independent of row order.
    """
    pages = lines.groupBy("doc_id", "page_num").agg(
        F.round(F.sum(F.col("confidence").cast("decimal(10,6)")) / F.count("*"), 4).alias("_c"), F.count("*").alias("n_lines")
    )
    docs = pages.groupBy("doc_id").agg(
        F.round(F.sum(F.col("_c").cast("decimal(10,6)")) / F.count("*"), 4).cast("double").alias("average_confidence"),
        F.count("*").alias("n_pages"),
    )
    return pages.withColumn("average_confidence", F.col("_c").cast("double")).drop("_c"), docs


def field_confidence(fields: DataFrame, lines: DataFrame, docs: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """A4: mean over kept fields, else over raw fields, else the document's.

    A field takes the confidence of the first line that contains its value.
    """
    from inkwell.operators.extract import line_confidence

    scored = line_confidence(fields.withColumn("needle", F.col("value")), lines)
    if kept is not None:
        scored = scored.join(
            kept.select("doc_id", "field").distinct().withColumn("_kept", F.lit(True)), ["doc_id", "field"], "left"
        )
    else:
        scored = scored.withColumn("_kept", F.lit(True))
    dec = F.col("confidence").cast("decimal(10,6)")
    means = scored.groupBy("doc_id").agg(
        (F.sum(F.when(F.col("_kept"), dec)) / F.count(F.when(F.col("_kept"), 1))).alias("_mk"),
        (F.sum(dec) / F.count("*")).alias("_mr"),
    )
    return docs.select("doc_id", "average_confidence").join(means, "doc_id", "left").select(
        "doc_id", F.round(F.coalesce("_mk", "_mr", F.col("average_confidence").cast("decimal(18,10)")), 4).cast("double").alias("confidence")
    )


def _min_max(bbox: Column) -> list[Column]:
    """x0, y0, x1, y1 of a four-point box."""
    xs, ys = F.transform(bbox, lambda p: p[0]), F.transform(bbox, lambda p: p[1])
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]


def with_corners(lines: DataFrame, bbox: str = "bbox") -> DataFrame:
    return lines.select("*", *_min_max(F.col(bbox)))


def reading_order(lines: DataFrame, *ties: Column) -> DataFrame:
    """15-pixel row bands from the top, left to right inside a band; ``ties`` order what is still equal."""
    band = F.bround(F.col("y0") / ROW_BAND) * ROW_BAND
    order = Window.partitionBy("doc_id", "page_num").orderBy(F.coalesce(band, F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), "line_no", *ties)
    return lines.withColumn("reading_pos", F.row_number().over(order))


def _pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidate pairs of boxes on the same page that overlap enough."""

    def banded(df: DataFrame, side: str) -> DataFrame:
        renamed = df.select(
            "doc_id", "page_num", F.col("line_no").alias(f"{side}_no"), *[F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")]
        )
        bands = F.sequence(F.floor(F.col(f"{side}_y0") / CELL), F.floor(F.greatest(f"{side}_y0", f"{side}_y1") / CELL))
        return renamed.withColumn("_band", F.explode(bands))

    met = banded(first, "a").join(banded(second, "b"), ["doc_id", "page_num", "_band"])
    # a pair counts in the first band that both boxes reach
    met = met.filter(F.col("_band") == F.greatest(*[F.floor(F.col(f"{s}_y0") / CELL) for s in ("a", "b")]))
    w = F.greatest(F.lit(0.0), F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"))
    h = F.greatest(F.lit(0.0), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    area_a, area_b = (
        F.greatest(F.lit(0.0), (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))) for s in ("a", "b")
    )
    met = met.withColumns({"_i": w * h, "_a": area_a, "_b": area_b}).filter("_i > 0 AND _a > 0 AND _b > 0")
    iou, small = F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i")), F.col("_i") / F.least("_a", "_b")
    met = met.withColumns({"iou": iou, "share": small}).filter((F.col("iou") >= PAIR_IOU) | (F.col("share") >= PAIR_MIN_AREA))
    return met.select("doc_id", "page_num", "a_no", "b_no", "share")


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First-pass lines in order take their best partner still free; a pair that comes again finds both taken.

    Rows arrive sorted by page, line and preference; only the lines of the
    current page that are already taken are remembered.
    """
    page, taken = None, set()
    for pdf in batches:
        keep = []
        for doc, num, a, b in zip(pdf["doc_id"], pdf["page_num"], pdf["a_no"], pdf["b_no"]):
            if page != (doc, num):
                page, taken = (doc, num), set()
            free = ("a", a) not in taken and ("b", b) not in taken
            if free:
                taken |= {("a", a), ("b", b)}
            keep.append(free)
        yield pdf.loc[keep, ["doc_id", "page_num", "a_no", "b_no"]]


def merge_passes(lines_en: DataFrame, lines_dev: DataFrame) -> DataFrame:
    """Two recognition passes of a page merged into one set of lines.

    Only overlapping pairs reach Python, streamed in page order.  The chosen ones are written, and the lines of both passes go
    with them through one shuffle, by page: there they are told their partners, which of them stay, and their places.
    """
    with shuffles_dropped(lines_en.sparkSession):
        chosen = cut_lineage(_chosen(lines_en, lines_dev))
    keep = ["doc_id", "page_num", "line_no", "text", "confidence", "x0", "y0", "x1", "y1"]
    number = dict(chosen.dtypes)["a_no"]
    en, dev = (
        df.select(*keep, F.lit(dev).alias("_dev"), F.lit(None).cast(number).alias("_other"), F.lit(False).alias("_mark"))
        for df, dev in ((lines_en, False), (lines_dev, True))
    )
    marks = chosen.where("a_no IS NOT NULL AND b_no IS NOT NULL").select(
        "doc_id", "page_num", F.col("b_no").alias("line_no"), F.lit(True).alias("_dev"), F.col("a_no").alias("_other"), F.lit(True).alias("_mark")
    )
    rows = en.unionByName(dev).unionByName(marks, allowMissingColumns=True).repartition("doc_id", "page_num")
    # a pair goes by the number of its first-pass line; lines without a number have no partner
    same = Window.partitionBy("doc_id", "page_num", "_dev", "line_no")
    paired = rows.withColumn("_other", F.max("_other").over(same)).where("NOT _mark")
    paired = paired.withColumn("_pair", F.when(F.col("_dev"), F.col("_other")).otherwise(F.col("line_no")))
    dev_letters = F.regexp_count("text", F.lit("[\u0900-\u097F]"))
    latin = F.regexp_count("text", F.lit("[A-Za-z]"))
    paired = paired.withColumn("_scripted", (dev_letters >= 2) | ((dev_letters >= 1) & (latin == 0)))
    pair = Window.partitionBy("doc_id", "page_num", "_pair")
    own = F.struct("confidence", "_scripted", "line_no")

    def partners(are: Column) -> Column:
        return F.collect_list(F.when(F.col("_pair").isNotNull() & are, own)).over(pair)

    def dev_wins(a: Column, b: Column) -> Column:
        a_conf, b_conf, a_scripted, b_scripted = a["confidence"], b["confidence"], a["_scripted"], b["_scripted"]
        wins = F.when(
            b_scripted & ~a_scripted, (b_conf >= 0.50) | (b_conf >= a_conf - 0.20) | (a_conf <= b_conf)
        ).when(a_scripted & ~b_scripted, F.lit(False)).otherwise(b_conf > a_conf)
        return F.coalesce(wins, F.lit(False))

    paired = paired.withColumns({"_as": partners(~F.col("_dev")), "_bs": partners(F.col("_dev"))})
    others = F.when(F.col("_dev"), F.col("_as")).otherwise(F.col("_bs"))
    won = F.when(F.col("_dev"), F.size(F.filter("_as", lambda a: dev_wins(a, own)))).otherwise(
        F.size(F.filter("_bs", lambda b: ~dev_wins(own, b)))
    )
    # a line stands once for each partner it wins against: lines of one number are all partners of the other's
    times = F.when(F.col("_pair").isNull() | (F.size(others) == 0), 1).otherwise(won)
    # of lines at one place those without a second-pass line come first, then by its number
    second = F.when(F.col("_dev"), F.col("line_no")).otherwise(F.get("_bs", F.lit(0))["line_no"])
    merged = paired.withColumn("_times", times).where("_times > 0").select(
        *keep, second.alias("_second"), "_dev", F.when(F.col("_dev"), "dev").otherwise("en").alias("source_pass"), F.explode(F.array_repeat(F.lit(True), F.col("_times"))).alias("_once")
    )
    return reading_order(merged.drop("_once"), F.col("_second"), F.col("_dev")).drop("_second", "_dev")


def _chosen(lines_en: DataFrame, lines_dev: DataFrame) -> DataFrame:
    """The pairs that the first pass' lines take: ``doc_id``, ``page_num``, ``a_no``, ``b_no``."""
    pairs = _pairs(lines_en, lines_dev).repartition("doc_id", "page_num").sortWithinPartitions(
        "doc_id", "page_num", "a_no", F.desc("share"), "b_no"
    )
    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(_greedy, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "page_num", "a_no", "b_no")))
