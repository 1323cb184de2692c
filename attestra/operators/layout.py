"""Recognised words to lines, blocks, pages and markdown (X14-X16, A19-A21, W5, W6), and a grey threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A20."""
    return F.array(F.min(x0), F.min(y0), F.max(x1), F.max(y1))


def lines(words: DataFrame, *page: str) -> DataFrame:
    """Words of one block and line in order. Empty words go; confidence is a percentage, at least 0."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    kept = words.select(*page, "block_num", "line_num", "ord", text.alias("t"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), (F.greatest(F.col("conf").cast("double"), F.lit(0.0)) / 100).alias("c")).where("t <> ''")
    return kept.groupBy(*page, "block_num", "line_num").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda w: w["t"]), " ").alias("text"),
        _bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"),
        F.sum("c").alias("c_sum"), F.count(F.lit(1)).alias("n_words"), F.round(F.avg("c"), 4).alias("confidence"),
    )


def blocks(words: DataFrame, *page: str) -> DataFrame:
    """Lines of one block in order; a block's confidence is the mean over its words."""
    x = lambda i: F.get("bbox", F.lit(i))
    return lines(words, *page).groupBy(*page, "block_num").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_num", "text"))), lambda w: w["text"]), "\n").alias("text"),
        _bbox(x(0), x(1), x(2), x(3)).alias("bbox"),
        F.round(F.sum("c_sum") / F.sum("n_words"), 4).alias("confidence"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_lines"),
    )


def page_markdown(blocks_: DataFrame, doc: str, page_index: str, blank_after_page: bool = False) -> DataFrame:
    """Blocks by top, then left edge, a heading for each page; the stored form has a further blank line after a page."""
    order = F.struct(F.get("bbox", F.lit(1)).alias("y"), F.get("bbox", F.lit(0)).alias("x"), F.col("block_num"), F.col("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda b: F.concat(b["text"], F.lit("\n"))), "\n")
    pages = blocks_.groupBy(doc, page_index).agg(body.alias("body"))
    part = F.concat(F.format_string("# Page %d\n", F.col("i") + 1), F.lit("\n"), F.col("body"), F.lit("\n" if blank_after_page else ""))
    parts = pages.select(doc, F.col(page_index).alias("i"), "body").select(doc, "i", part.alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda p: p["part"]), "\n")
    return parts.groupBy(doc).agg(F.concat(F.regexp_replace(whole, r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def polygon_bbox(polygon: Column, box: Column) -> Column:
    """Extremes of the points, else the box, else zeros. Coordinates lose their decimals."""
    at = lambda i: F.transform(polygon, lambda p: F.get(p, F.lit(i)).cast("int"))
    points = F.array(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(0)), F.array_max(at(1)))
    return F.coalesce(F.when(F.size(polygon) > 0, points), F.transform(F.slice(box, 1, 4), lambda x: x.cast("int")), F.array(*[F.lit(0)] * 4))


def _first(result: object, names: tuple[str, ...]) -> object:
    """The first of some fields that a result has, by key or by attribute."""
    for n in names:
        value = result.get(n) if isinstance(result, dict) else getattr(result, n, None)
        if value is not None:
            return value
    return None


def recognised(result: object) -> tuple[list, list, list | None, list | None]:
    """Texts, scores, polygons and boxes of a recogniser's result, whatever its form: a dict, a dict under
    ``res``, or an object with these as attributes. A result without texts gives none. Runs in a batch function."""
    inner = _first(result, ("res",))
    forms = [inner if isinstance(inner, dict) else result, result] if not isinstance(result, dict) else [inner if inner is not None else result]
    for form in forms:
        texts = _first(form, ("rec_texts", "texts"))
        if texts is not None and len(texts):
            scores = _first(form, ("rec_scores", "scores"))
            return list(texts), list(scores) if scores is not None else [], _first(form, ("dt_polys", "rec_polys")), _first(form, ("rec_boxes",))
    return [], [], None, None


def otsu_threshold(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """The grey value that parts an image's pixels with the greatest variance between classes; of equal ones the least.

    256 counted bins an image, then running sums over them.
    """
    counted = pixels.groupBy(image, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    spine = counted.select(image).distinct().select(image, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    bins = spine.join(counted, [image, "v"], "left").fillna({"n": 0})
    upto, all_ = Window.partitionBy(image).orderBy("v"), Window.partitionBy(image)
    sums = bins.select(image, "v", F.sum("n").over(upto).alias("c"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s"), F.sum("n").over(all_).alias("ca"), F.sum(F.col("n") * F.col("v")).over(all_).alias("sa"))
    zero = F.lit(0.0)
    back, front = F.coalesce(F.try_divide(F.col("s"), F.col("c")), zero), F.coalesce(F.try_divide(F.col("sa") - F.col("s"), F.col("ca") - F.col("c")), zero)
    weight = F.col("c") / F.col("ca")
    scored = sums.select(image, "v", (weight * (1 - weight) * (back - front) * (back - front)).alias("between"))
    return scored.groupBy(image).agg(F.max(F.struct("between", (-F.col("v")).alias("nv"))).alias("m")).select(image, (-F.col("m.nv")).alias("threshold"))
