from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import transforms as tr
from quirefold.sources.schemas import PAGES


def element(content, x=0.0, y=10.0, width=20.0, height=10.0, label="text"):
    x, y, width, height = float(x), float(y), float(width), float(height)
    return ([(x, y), (x + width, y), (x + width, y + height), (x, y + height)], label, content)


def plain(content, label="text"):
    return ([], label, content)


def run(spark, elements, transform):
    row = spark.createDataFrame([("d", 0, elements)], PAGES).select(transform(F.col("elements")).alias("e")).first()
    return [([(p.x, p.y) for p in e.bbox], e.label, e.content) for e in row.e]


def box(e):
    xs, ys = [p[0] for p in e[0]], [p[1] for p in e[0]]
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def test_rules_apply_in_order(spark):
    t = tr.pipeline(tr.replace_text({"foo": "bar", "bar": "baz"}), tr.remove_text(["mark"]), tr.filter_elements(lambda e: e["content"] != ""))
    assert [e[2] for e in run(spark, [plain("foo mark"), plain("mark"), plain("bar")], t)] == ["baz ", "baz"]


def test_map_keeps_order_and_length(spark):
    t = tr.map_elements(lambda e: F.struct(e["bbox"].alias("bbox"), e["label"].alias("label"), F.upper(e["content"]).alias("content")))
    assert [e[2] for e in run(spark, [plain("b"), plain("a"), plain("b")], t)] == ["B", "A", "B"]
    assert run(spark, [], t) == []


def test_multiline_elements_split_evenly(spark):
    got = run(spark, [element("one\ntwo\nthree", 10, 100, 490, 90)], tr.split_multiline())
    assert [(e[2], *box(e)) for e in got] == [("one", 10, 100, 500, 130), ("two", 10, 130, 500, 160), ("three", 10, 160, 500, 190)]


def test_blank_lines_take_their_share(spark):
    got = run(spark, [element("a\n \nb", 0, 0, 10, 30)], tr.split_multiline())
    assert [(e[2], box(e)[1], box(e)[3]) for e in got] == [("a", 0, 10), ("b", 20, 30)]
    kept = run(spark, [plain("a\r\n\r\nb")], tr.split_multiline(keep_empty=True))
    assert [(e[2], box(e)) for e in kept] == [("a", None), ("", None), ("b", None)]


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\r\n", "a\rb\x0bc\x0cd\x1ce\x85f g h", "\n\n"])
def test_lines_are_those_between_boundaries(spark, text):
    import re

    want = re.split("\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85  ]", text)
    got = run(spark, [plain(text)], tr.split_multiline(keep_empty=True))
    assert [e[2] for e in got] == (want if len(want) > 1 else [text])


def test_other_labels_stay_whole(spark):
    assert len(run(spark, [plain("a\nb", "table")], tr.split_multiline())) == 1


def test_regions(spark):
    page = [element("top", y=1, height=2), element("mid", y=40), element("low", y=91, height=5), plain("free")]
    bands = [(0, 0, 100, 15), (0, 85, 100, 100)]
    assert [e[2] for e in run(spark, page, tr.remove_in_regions(bands))] == ["mid", "free"]
    assert [e[2] for e in run(spark, page, tr.remove_in_regions(bands, remove_without_bbox=True))] == ["mid"]
    assert [e[2] for e in run(spark, [element("a", y=10, height=10)], tr.remove_in_regions(bands, "contained"))] == ["a"]
    assert run(spark, [element("a", y=10, height=10)], tr.remove_in_regions(bands, "overlap", 0.5)) == []
    assert run(spark, [element("flat", height=0)], tr.remove_in_regions([(500, 500, 501, 501)], "overlap", 0)) == []
    assert [e[2] for e in run(spark, page, tr.remove_in_regions([]))] == ["top", "mid", "low", "free"]


@pytest.mark.parametrize("bad", [{"match": "near"}, {"min_overlap": 2.0}])
def test_bad_regions(bad):
    with pytest.raises(ValueError):
        tr.remove_in_regions([], **bad)


def test_elements_on_a_line_merge(spark):
    got = run(spark, [element("No.", 54, 10, 94), element(" 12", 159, 11, 188)], tr.merge_collinear())
    assert [(e[2], *box(e)) for e in got] == [("No. 12", 54, 10, 347, 21)]


@pytest.mark.parametrize("second", [element("b", 500), element("b", 25, label="table"), plain("b"), element("b", 25, y=100), element("b", 5)])
def test_others_do_not(spark, second):
    assert len(run(spark, [element("a"), second], tr.merge_collinear())) == 2


def python_merge(page):
    done = []
    for e in page:
        if done and done[-1][1] == e[1] and done[-1][0] and e[0]:
            a, b = box(done[-1]), box(e)
            ha, hb = a[3] - a[1], b[3] - b[1]
            shared = max(0, min(a[3], b[3]) - max(a[1], b[1]))
            if ha > 0 and hb > 0 and b[0] >= a[2] and shared / min(ha, hb) >= 0.8 and b[0] - a[2] <= 2 * max(ha, hb):
                x0, y0, x1, y1 = min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])
                done[-1] = ([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], e[1], done[-1][2] + "-" + e[2])
                continue
        done.append(e)
    return done


def test_merging_against_a_fold(spark):
    rng = random.Random(0)
    for _ in range(5):
        x, page = 0.0, []
        for i in range(25):
            x += rng.choice([20, 25, 35, 60, -10])
            page.append(element(str(i), x, rng.choice([10, 10, 10, 11, 14]), 20, rng.choice([10, 10, 8, 0])) if rng.random() < 0.9 else plain(str(i)))
        assert run(spark, page, tr.merge_collinear(separator="-")) == python_merge(page)


def test_two_columns(spark):
    got = spark.createDataFrame([("d", 0, [element(str(x), x) for x in (810.0, 100.0, 850.0, 180.0)])], PAGES).select(tr.two_columns(F.col("elements")).alias("c")).first().c
    assert [e.content for e in got.left] == ["100.0", "180.0"] and [e.content for e in got.right] == ["810.0", "850.0"]


def test_columns_of_equal_and_no_points(spark):
    rows = spark.createDataFrame([([5.0, 5.0],), ([],), ([1.0, 2.0, 3.0],)], "xs array<double>").select(tr.column_of(F.col("xs")).alias("s")).collect()
    assert [r.s for r in rows] == [[0, 0], [], [0, 0, 1]]


def test_columns_need_points(spark):
    with pytest.raises(Exception, match="element without bbox: 1"):
        spark.createDataFrame([("d", 0, [element("a"), plain("b")])], PAGES).select(tr.two_columns(F.col("elements"))).collect()


def test_layout_chain(spark):
    page = [plain("（Ａ）\n\n$\\textcircled{3}$ x\n\n\n\ny"), plain("t", "table")]
    assert [e[2] for e in run(spark, page, tr.layout_chain())] == ["(A)", "③ x", "y"]
    assert [e[2] for e in run(spark, [plain("Ａ")], tr.raster_chain())] == ["A"]
    assert [e[2] for e in run(spark, [plain("Ａ")], tr.text_layer_chain())] == ["Ａ"]
