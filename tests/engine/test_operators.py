"""Operators on small tables, against plain versions where there is one."""

import random

from pyspark.sql import functions as F

from lumenaudit.functions import scalar as S
from lumenaudit.functions import text as X
from lumenaudit.operators import anchors, headings, issues, pdf_rules, slide_rules
from lumenaudit.sources import trees


class Node:
    def __init__(self, level, parent):
        self.level, self.parent = level, parent


def literal_tree(levels):
    """Error codes by position: headings hang below an ancestor one level up, searched from the active one."""
    root = active = None
    out = {}
    for i, level in enumerate(levels, 1):
        if level is not None and level < 1:
            out[i] = 1001
        elif root is None:
            if active is None or level == 1:
                active = Node(level, None)
                root = active if level == 1 else None
            else:
                out[i] = 1002
        elif level == 1:
            out[i] = 1003
        else:
            at = active
            while at is not None and level is not None and at.level != level - 1:
                at = at.parent
            if at is None or level is None:
                out[i] = 1004
            else:
                active = Node(level, at)
    return out


def test_headings_against_a_tree(spark):
    rng = random.Random(1)
    cases = [[rng.choice([None, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6]) for _ in range(rng.randint(0, 14))] for _ in range(2000)]
    cases.append([1, 2, 3, 3, 3, 2, 3, 4, 4, 1, 6, 2, 3, 2, 3, 4, 2, 3, 4, 5, 3, 2, 3, 4, 4])
    rows = [(n, i, level) for n, levels in enumerate(cases) for i, level in enumerate(levels, 1)]
    got = {}
    for r in headings.check_headings(spark.createDataFrame(rows, "path long, pos int, level int").repartition(3)).collect():
        got.setdefault(r.path, {})[r.pos] = r.code
    for n, levels in enumerate(cases):
        assert got.get(n, {}) == literal_tree(levels), levels


def test_docx_headings(spark):
    rows = [(1, "Heading1", " a "), (2, "heading 2", "b"), (3, "HEADING", "c"), (4, "Normal", "d"), (5, "Heading3", "  "), (6, None, "e"), (7, "Heading12", "f")]
    df = spark.createDataFrame([("p", *r) for r in rows], "path string, para_ord int, style_id string, text string")
    assert [(r.pos, r.level, r.text) for r in headings.docx_headings(df).orderBy("pos").collect()] == [(1, 1, "a"), (2, 2, "b"), (3, None, "c"), (4, 12, "f")]
    assert headings.outline(headings.docx_headings(df)).first().outline.startswith("a\n  b\nc\n")


def test_anchor_tiers(spark):
    runs = [("d", 1, 1, "alpha"), ("d", 1, 2, "beta gamma"), ("d", 2, 1, "del"), ("d", 2, 2, "ta"), ("d", 3, 1, "beta"), ("e", 1, 1, "delta")]
    targets = [("d", 1, "beta"), ("d", 2, "gam"), ("d", 3, "delta"), ("d", 4, "none"), ("d", 5, ""), ("f", 6, "x")]
    got = anchors.find_anchors(spark.createDataFrame(targets, "path string, target_id int, target string"), spark.createDataFrame(runs, "path string, para_ord int, run_ord int, text string"))
    assert {r.target_id: (r.tier, r.para_ord, r.run_ord) for r in got.collect()} == {1: (1, 3, 1), 2: (2, 1, 2), 3: (3, 2, 2), 4: (None, None, None), 5: (2, 1, 1), 6: (None, None, None)}


def test_text(spark):
    texts = ["Click here", "abc", "see www.x", None, "", "  four  ", "HTTP stuff", "12, 34!", "a1b2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unclear_link(F.col("t")).alias("u"), X.is_substantial(F.col("t")).alias("s")).collect()
    assert [r.u for r in rows] == [False, True, True, True, True, True, True, False, True]
    assert [r.s for r in rows] == [True, False, True, None, False, True, True, False, True]
    both = spark.createDataFrame([("http://a", "http://a"), ("see", "http://a"), (" http", "x"), ("", "x"), ("http", None)], "t string, u string")
    assert [r[0] for r in both.select(X.raw_url_link(F.col("t"), F.col("u"))).collect()] == [True, False, True, False, False]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(S.contrast(F.lit("777777")) < 4.5) and not value(S.contrast(F.lit("767676")) < 4.5) and round(value(S.contrast(F.lit(None).cast("string"))), 3) == 21
    assert value(S.percentage(F.lit(1), F.lit(0))) == 0 and value(S.percentage(F.lit(1), F.lit(8))) == 12.5 and value(S.percentage(F.lit(2), F.lit(3))) == 66.7
    assert value(S.format_size(F.lit(1 << 20))) == "1.00 MB" and value(S.format_size(F.lit(12))) == "12 bytes"
    assert value(S.attachment_name(F.lit('attachment; filename="a b.pdf"'))) == "a b.pdf" and value(S.attachment_name(F.lit("inline"))) is None
    assert value(S.node_id(F.lit("x?objId=42&y"))) == 42 and value(S.node_id(F.lit("x"))) is None
    assert value(S.rect_box(F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0))))).asDict() == {"x": 1, "y": 2, "width": 3, "height": 6}
    assert value(S.rect_box(F.lit(None).cast("array<double>"))).width == 0
    assert value(issues.issue_message(F.lit(2), "image", F.array(F.lit(1), F.lit(3)))) == "2 images on pages 1, 3"
    assert value(S.join_path(F.lit("./"), F.lit("a"))) == "a" and value(S.join_path(F.lit("x/"), F.lit("a"))) == "x/a"


def test_walk(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (9, 8)], "id long, parent_id long")
    assert {(r.id, r.depth) for r in trees.walk(nodes).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}
    assert {(r.id, r.depth) for r in trees.walk(nodes, 2).collect()} == {(3, 1), (4, 1)}


def test_figures_and_links(spark):
    nodes = spark.createDataFrame([("p", 1, 2, "Figure", "second"), ("p", 1, 1, "Figure", "first"), ("p", 2, 3, "Figure", ""), ("p", 2, 4, "P", "x")], "path string, page int, preorder int, role string, alt string")
    images = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("p", 2, 1)], "path string, page int, img_ord int")
    assert {(r.page, r.img_ord, r.alt) for r in pdf_rules.images_with_alt(images, nodes).collect()} == {(1, 1, "first"), (1, 2, "first"), (2, 1, None)}
    rels = spark.createDataFrame([("p", 1, 1, "r1", "t/hyperlink", "old"), ("p", 1, 2, "r1", "t/hyperlink", "new"), ("p", 1, 3, "r2", "t/image", "pic")], "path string, slide int, rel_ord int, rel_id string, rel_type string, target string")
    runs = spark.createDataFrame([("p", 1, "r1"), ("p", 1, "r2"), ("p", 2, "r1")], "path string, slide int, link_id string")
    assert sorted((r.slide, r.link_id, r.target) for r in slide_rules.link_targets(runs, rels).collect()) == [(1, "r1", "new"), (1, "r2", None), (2, "r1", None)]
