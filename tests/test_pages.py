"""Edge rows of positioned words, boxes and tables."""

from tessellum.operators import pages

WORDS = "doc long, page long, seq long, text string, x0 double, top double, x1 double, bottom double, size double, font_name string"


def word(seq, text, x0, top, size=10.0, font=None, doc=1, page=1):
    return (doc, page, seq, text, x0, top, None if x0 is None else x0 + 10, None if top is None else top + 8, size, font)


def test_a_line_breaks_by_its_first_word_and_not_by_neighbours(spark):
    rows = [word(k, f"w{k}", 10.0 * k, 3.0 * k) for k in range(6)] + [word(9, "last", 5.0, 20.25), word(8, "first", 5.0, 20.25), word(10, None, 7.0, 20.25)]
    rows += [word(11, "", 1.0, 60.0, 0.0), word(12, "nowhere", 1.0, None), word(13, " x ", 1.0, 1.0, None, "Arial-BoldMT", page=2)]
    got = sorted((r.page, r.line, r.text, r.y0, r.y1, r.font, r.bold) for r in pages.word_lines(spark.createDataFrame(rows, WORDS), ["doc", "page"]).collect())
    assert got == [
        (1, 0, "w0 w1", 0.0, 11.0, 10.0, False), (1, 1, "w2 w3", 6.0, 17.0, 10.0, False), (1, 2, "w4 w5", 12.0, 23.0, 10.0, False),
        (1, 3, "first last", 20.25, 28.25, 10.0, False), (1, 4, "", 60.0, 68.0, 10.0, False), (2, 0, "x", 1.0, 9.0, 10.0, True),
    ]
    assert pages.word_lines(spark.createDataFrame([], WORDS), ["doc", "page"]).count() == 0


def test_lines_at_the_margin_of_boxes_go(spark):
    lines = spark.createDataFrame([(1, k, 10.0, float(y), 20.0, float(y + 8)) for k, y in enumerate((0, 27, 26.75, 100, 118, 118.25, 500))], "page long, line int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0.0, 40.0, 100.0, 113.0), (1, 25.0, 500.0, 26.0, 500.0), (1, 25.5, 0.0, 30.0, 1.0), (2, 0.0, 0.0, 999.0, 999.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    # 35 + 5 touches 40, 118 - 5 touches 113, 20 + 5 touches 25
    assert sorted(r.line for r in pages.outside_boxes(lines, boxes, ["page"]).collect()) == [0, 2, 5]


def test_numbers_go_through_a_document(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 4), (1, 3, 1), (1, 2, 9), (2, 7, 1), (None, 1, 1)], "doc long, page int, k int")
    got = sorted(((r.doc, r.page, r.k), r.n) for r in pages.numbered(rows, "doc", "page", ["k"], "n").collect() if r.doc)
    assert got == [((1, 1, 4), 0), ((1, 1, 5), 1), ((1, 2, 9), 2), ((1, 3, 1), 3), ((2, 7, 1), 0)]


def test_second_strategy_only_where_the_first_found_nothing(spark):
    kind = "doc long, page int, number int, cells array<array<string>>"
    table = [[None, " a  b "], ["", None], ["x", "\ty"]]
    ruled = spark.createDataFrame([(1, 1, 0, [["only"]]), (1, 2, 0, table), (1, 2, 1, [["h"], [" "], [None]])], kind)
    aligned = spark.createDataFrame([(1, 1, 0, table), (1, 2, 0, table), (1, 3, 2, table), (1, 4, 0, [])], kind)
    boxes = spark.createDataFrame([(1, 3, 2, 0.0, 51.0, 9.0, 60.0)], "doc long, page int, number int, x0 double, y0 double, x1 double, y1 double")
    elements = spark.createDataFrame([(1, 3, k, f"e{k}", "table", float(y)) for k, y in enumerate((50, 99, 100))], "doc long, page int, seq long, element_id string, element_type string, y0 double")
    lines = spark.createDataFrame([(1, 3, "Table 1: x", 0.0, 20.0, 9.0, 30.0)], "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page, r.seq, r.table_id, r.headers, r.rows, r.caption, r.element_id) for r in pages.page_tables(ruled, aligned, boxes, elements, lines, "doc", "page").collect())
    # page 1 has a ruled table, which is too small, so nothing there
    assert got == [(2, 0, "1_p2_t0", ["Column_1", "a b"], [["x", "y"]], None, None), (3, 1, "1_p3_t1", ["Column_1", "a b"], [["x", "y"]], "Table 1: x", "e1")]


def test_words_dealt_by_page_stay_where_they_are(spark):
    rows = [word(k, f"w{k}", 10.0 * (k % 7), 3.0 * (k % 11), doc=k % 3, page=k % 5) for k in range(200)]
    dealt = spark.createDataFrame(rows, WORDS).repartition(3, "doc", "page")
    lines = pages.word_lines(dealt, ["doc", "page"])
    boxes = dealt.select("doc", "page").distinct().selectExpr("*", "5.0D AS x0", "9.0D AS y0", "20.0D AS x1", "20.0D AS y1")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(lines).count("Exchange") == 1
    free = pages.outside_boxes(lines, boxes, ["doc", "page"])
    assert plan(free).count("Exchange") == 3  # lines move once to meet boxes, which stay
    shared = pages.word_lines(dealt, ["doc", "page"], parts=3)
    assert plan(pages.outside_boxes(shared, boxes, ["doc", "page"])).count("Exchange") == 3 and sorted(shared.collect()) == sorted(lines.collect())
    assert 0 < free.count() < lines.count()


def test_words_of_one_place_go_by_text_and_nulls_first(spark):
    rows = [word(1, "b", 5.0, 1.0), word(1, "a", 5.0, 1.0), word(0, "c", None, 1.0), word(None, "d", 5.0, 1.0), word(2, None, None, 90.0, None), word(3, "x", 1.0, float("nan")), word(4, "y", 2.0, float("nan"))]
    got = [(r.line, r.text, r.x0, r.x1, r.font) for r in pages.word_lines(spark.createDataFrame(rows, WORDS), ["doc", "page"]).orderBy("line").collect()]
    assert got == [(0, "c d a b", 5.0, 15.0, 10.0), (1, "", None, None, 10.0), (2, "x y", 1.0, 12.0, 10.0)]
