"""Page transforms: functions from a column of page elements to another, and partitions into columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import bind, circled_numbers, fullwidth_to_halfwidth, is_blank, split_lines
from quirefold.sources.schemas import ELEMENT

Transform = Callable[[Column], Column]
FOLD_ROUNDS, FEW_ROUNDS = 100, 4


def pipeline(*transforms: Transform) -> Transform:
    """The transforms one after the other."""
    return lambda elements: reduce(lambda e, t: t(e), transforms, elements)


def map_elements(f: Callable[[Column], Column]) -> Transform:
    return lambda elements: F.transform(elements, f)


def _content(f: Callable[[Column], Column]) -> Transform:
    return map_elements(lambda e: F.struct(e["bbox"].alias("bbox"), e["label"].alias("label"), f(e["content"]).alias("content")))


def replace_text(rules: dict[str, str]) -> Transform:
    """Literal replacements in the order of rules; later ones see what earlier ones made."""
    return _content(lambda c: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), rules.items(), c))


def remove_text(parts: list[str]) -> Transform:
    return replace_text(dict.fromkeys(parts, ""))


def filter_elements(keep: Callable[[Column], Column]) -> Transform:
    return lambda elements: F.filter(elements, keep)


def bounds(e: Column) -> Column:
    """(x0, y0, x1, y1) of an element's polygon; null without points."""
    xs, ys = F.transform(e["bbox"], lambda p: p["x"]), F.transform(e["bbox"], lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(e["bbox"]) > 0, box)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Four points, clockwise from the top left."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def split_multiline(labels: tuple[str, ...] = ("text",), keep_empty: bool = False) -> Transform:
    """An element for each line of elements of the labels, each with its share of the box's height; blank lines go but take their share."""

    def one(e: Column) -> Column:
        def parts(b: Column) -> Column:
            box, n = b["box"], F.size(b["lines"])
            high = (box["y1"] - box["y0"]) / n

            def line(text: Column, i: Column) -> Column:
                part = rectangle(box["x0"], box["y0"] + high * i, box["x1"], box["y0"] + high * (i + 1))
                return F.struct(F.when(box.isNull(), e["bbox"]).otherwise(part).alias("bbox"), e["label"].alias("label"), text.alias("content"))

            made = F.transform(b["lines"], line)
            made = made if keep_empty else F.filter(made, lambda x: ~is_blank(x["content"]))
            return F.when(n > 1, made).otherwise(F.array(e))

        split = bind(F.struct(split_lines(e["content"]).alias("lines"), bounds(e).alias("box")), parts)
        return F.when(e["label"].isin(*labels), split).otherwise(F.array(e))

    return lambda elements: F.flatten(F.transform(elements, one))


def remove_in_regions(regions: list[tuple[float, float, float, float]], match: str = "center", min_overlap: float = 0.5, remove_without_bbox: bool = False) -> Transform:
    """Without the elements whose center is in a region, or that a region contains, or overlaps by a share of their own area. Edges count as inside."""
    if match not in ("center", "contained", "overlap"):
        raise ValueError(f"unknown match: {match}")
    if not 0 <= min_overlap <= 1:
        raise ValueError("min_overlap must be between 0 and 1")

    def inside(b: Column, r: tuple[float, float, float, float]) -> Column:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in r)
        if match == "center":
            return ((b["x0"] + b["x1"]) / 2).between(x0, x1) & ((b["y0"] + b["y1"]) / 2).between(y0, y1)
        if match == "contained":
            return (b["x0"] >= x0) & (b["y0"] >= y0) & (b["x1"] <= x1) & (b["y1"] <= y1)
        return overlap_ratio(b, r) >= min_overlap

    def kept(e: Column) -> Column:
        b = bounds(e)
        hit = reduce(lambda p, q: p | q, [inside(b, r) for r in regions], F.lit(False))
        return F.when(b.isNull(), F.lit(not remove_without_bbox)).otherwise(~hit)

    return lambda elements: F.filter(elements, kept)


def overlap_ratio(b: Column, r: tuple[float, float, float, float]) -> Column:
    """Share of a box's area that a region covers; 0 for a box without area."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in r)
    wide = F.greatest(F.lit(0.0), F.least(b["x1"], x1) - F.greatest(b["x0"], x0))
    high = F.greatest(F.lit(0.0), F.least(b["y1"], y1) - F.greatest(b["y0"], y0))
    area = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    return F.when(area > 0, wide * high / F.nullif(area, F.lit(0.0))).otherwise(F.lit(0.0))


def merge_collinear(min_vertical_overlap: float = 0.8, max_horizontal_gap_ratio: float = 2.0, separator: str = "") -> Transform:
    """Each element joined to what the one before has become, if they stand on one line close together: a fold, as joined boxes grow."""

    def step(done: Column, e: Column) -> Column:
        last = F.element_at(done, -1)
        a, b = bounds(last), bounds(e)
        ha, hb = a["y1"] - a["y0"], b["y1"] - b["y0"]
        shared = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        near = (last["label"] == e["label"]) & (ha > 0) & (hb > 0) & (b["x0"] >= a["x1"]) & (shared >= F.least(ha, hb) * min_vertical_overlap) & (b["x0"] - a["x1"] <= F.greatest(ha, hb) * max_horizontal_gap_ratio)
        box = rectangle(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))
        joined = F.struct(box.alias("bbox"), last["label"].alias("label"), F.concat(last["content"], F.lit(separator), e["content"]).alias("content"))
        return F.when((F.size(done) > 0) & F.coalesce(near, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(e)))

    return lambda elements: F.aggregate(elements, F.array().cast(f"array<{ELEMENT}>"), lambda done, e: F.when(F.size(done) == 0, F.array(e)).otherwise(step(done, e)))


def column_of(xs: Column) -> Column:
    """For an array of doubles, 0 (left) or 1 (right) each, by 2-means from the least and the greatest; ties go left, all-equal values are left.

    A settled state stays as it is in further rounds, so the few rounds that most pages need are followed by the rest only where they don't settle it.
    """

    def round_(c: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sl"), F.lit(0).alias("nl"), F.lit(0.0).alias("sr"), F.lit(0).alias("nr"))

        def add(a: Column, x: Column) -> Column:
            left = F.abs(x - c["l"]) <= F.abs(x - c["r"])
            more = lambda on, field, by: F.when(on, a[field] + by).otherwise(a[field]).alias(field)
            return F.struct(more(left, "sl", x), more(left, "nl", 1), more(~left, "sr", x), more(~left, "nr", 1))

        mean = lambda a, s, n, old: F.when(a[n] > 0, a[s] / a[n]).otherwise(c[old]).alias(old)
        return F.aggregate(xs, zero, add, lambda a: F.struct(mean(a, "sl", "nl", "l"), mean(a, "sr", "nr", "r")))

    def rounds(c: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), c, lambda state, _: round_(state))

    def settled(c: Column) -> Column:
        return F.when(round_(c) == c, c).otherwise(rounds(c, FOLD_ROUNDS - FEW_ROUNDS))

    def apart(e: Column) -> Column:
        """Whether there are two values alone, too far apart for the rounding of their means to matter: each is then a side, without a round."""
        wide = (F.abs(e["l"]) + F.abs(e["r"])) * 1e-6
        return (F.size(xs) < 1_000_000) & (F.abs(e["r"]) < 1e100) & (F.abs(e["l"]) < 1e100) & (e["r"] - e["l"] > wide) & F.forall(xs, lambda x: (x == e["l"]) | (x == e["r"]))

    ends = F.struct(F.array_min(xs).alias("l"), F.array_max(xs).alias("r"))
    sides = bind(bind(rounds(ends, FEW_ROUNDS), settled), lambda c: F.transform(xs, lambda x: (F.abs(x - c["l"]) > F.abs(x - c["r"])).cast("int")))
    return bind(
        F.struct(F.array_min(xs).alias("l"), F.array_max(xs).alias("r")),
        lambda e: F.when(F.size(xs) == 0, F.array().cast("array<int>")).when(e["l"] == e["r"], F.transform(xs, lambda x: F.lit(0))).when(apart(e), F.transform(xs, lambda x: (x == e["r"]).cast("int"))).otherwise(sides),
    )


def two_columns(elements: Column) -> Column:
    """A struct of left and right: the elements by the x of their first points. An element without points raises, by its number."""
    first_x = F.transform(elements, lambda e, i: F.coalesce(F.get(e["bbox"], F.lit(0))["x"], F.raise_error(F.concat(F.lit("element without bbox: "), i.cast("string"))).cast("double")))

    def parted(sides: Column) -> Column:
        zipped = F.transform(elements, lambda e, i: F.struct(e.alias("e"), F.get(sides, i).alias("s")))
        of = lambda k: F.transform(F.filter(zipped, lambda z: z["s"] == k), lambda z: z["e"])
        return F.struct(of(0).alias("left"), of(1).alias("right"))

    return bind(bind(first_x, column_of), parted)


def text_layer_chain() -> Transform:
    return merge_collinear()


def layout_chain() -> Transform:
    """What layout recognition needs: text elements alone, circled numbers, single line feeds, half-width forms, one element a line."""
    return pipeline(filter_elements(lambda e: e["label"] == "text"), _content(circled_numbers), replace_text({"\n\n": "\n"}), _content(fullwidth_to_halfwidth), split_multiline())


def raster_chain() -> Transform:
    return _content(fullwidth_to_halfwidth)
