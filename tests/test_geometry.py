"""Operators on word boxes that fold over a page, on small pages."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import drafts as dr
from gradeloom.operators import geometry as ge

SCHEMA = "job_id int, page int, word_id long, text string, x0 double, y0 double, x1 double, y1 double, conf double"


def page(spark, words, job=1, number=1):
    """words: (text, x, y); 8 wide a letter, 12 high."""
    rows = [(job, number, i, t, float(x), float(y), float(x + 8 * len(t)), float(y + 12), 0.9) for i, (t, x, y) in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def question(n, x, y, stem="stem words here", options="ABCD", mark="."):
    out = [(f"{n}{mark}", x, y)] + [(w, x + 40 + 70 * i, y) for i, w in enumerate(stem.split())]
    return out + [(f"({o})" if mark == "." else f"{o}.", x + 20, y + 20 * (i + 1)) for i, o in enumerate(options.lower())] + [("body", x + 60, y + 20 * (i + 1)) for i in range(len(options))]


def test_drafts_of_two_columns(spark):
    words = question(1, 10, 20) + question(2, 10, 200) + question(3, 320, 20) + question(4, 320, 200)
    got = dr.drafts_of_pages(page(spark, words), 620.0, 800.0).orderBy("position").collect()
    assert [(r.col, r.question_number, r.kind, r.options) for r in got] == [(0, 1, "MCQ", 4), (0, 2, "MCQ", 4), (1, 3, "MCQ", 4), (1, 4, "MCQ", 4)]
    assert [(r.page, r.n_cols, r.span_page_end) for r in got] == [(1, 2, None)] * 4
    assert [round(r.confidence, 2) for r in got] == [1.0, 1.0, 1.0, 0.8]


def test_incomplete_regions_merge(spark):
    # "2." has no options of its own, so it is a value within question 1
    words = question(1, 10, 20, options="") + [("2.", 10, 60), ("kg", 60, 60)] + [("(a)", 30, 90), ("x", 80, 90), ("(b)", 30, 110), ("y", 80, 110)] + question(3, 10, 200)
    w = page(spark, words)
    marks = ge.valid_sequence(ge.in_columns(ge.question_markers(w), 620.0))
    got = ge.merged_regions(ge.regions(marks, 620.0, 800.0), w).orderBy("y0").collect()
    assert [(r.y0, r.y1) for r in got] == [(15.0, 195.0), (195.0, 800.0)]


def test_regions_split_at_inner_numbers(spark):
    w = page(spark, question(1, 10, 20) + question(2, 10, 200))
    one = spark.createDataFrame([(1, 1, 0, 12.0, ".", 0, 5.0, 15.0, 620.0, 800.0)], "job_id int, page int, col int, h double, q_punct string, place int, x0 double, y0 double, x1 double, y1 double")
    got = ge.split_regions(one, w).orderBy("y0").collect()
    assert [(r.y0, r.y1) for r in got] == [(15.0, 195.0), (195.0, 800.0)]


def test_gaps_are_recovered(spark):
    # 102 has lost its mark; 4 is small and has none either, so it stays a value
    words = question(101, 10, 20) + [("102", 10, 200), ("next", 60, 200), ("4", 10, 300), ("x", 60, 300)] + question(103, 10, 400)
    w = page(spark, words)
    one = spark.createDataFrame([(1, 1, 0, 12.0, ".", 0, 5.0, 15.0, 620.0, 800.0)], "job_id int, page int, col int, h double, q_punct string, place int, x0 double, y0 double, x1 double, y1 double")
    got = ge.gap_splits(one, w).orderBy("y0").collect()
    assert [(r.y0, r.y1) for r in got] == [(15.0, 195.0), (195.0, 395.0), (395.0, 800.0)]


@pytest.mark.parametrize(
    "numbers, truncated, century",
    [
        ([109, 110, 1, 112], {2: 111}, {}),
        ([109, 110, 7, 112], {}, {}),
        ([168, 169, 270, 171], {}, {2: 170}),
        ([41, 12, 42, 43], {}, {}),
        ([1, 2, 3, 4], {}, {}),
        ([98, 99, 200, 101, 102], {}, {2: 100}),
    ],
)
def test_misread_numbers(spark, numbers, truncated, century):
    w = page(spark, [(f"{n}.", 10, 40 * i) for i, n in enumerate(numbers)])
    marks = ge.in_columns(ge.question_markers(w, None), 620.0)
    assert {r.word_id: r.num for r in ge.truncated_numbers(marks).collect()} == truncated
    assert {r.word_id: r.num for r in ge.century_numbers(marks).collect()} == century


def test_corrected_words(spark):
    w = page(spark, [("1.", 10, 0), ('"11.x', 10, 40)])
    fix = spark.createDataFrame([(1, 1, 1, 111)], "job_id int, page int, word_id long, num int")
    assert [r.text for r in ge.corrected(w, fix).orderBy("word_id").collect()] == ["1.", '"111.x']


def test_reading_order(spark):
    left = [(f"l{i}", 10 + 60 * (i % 3), 20 + 20 * (i // 3)) for i in range(18)]
    right = [(f"r{i}", 400 + 60 * (i % 3), 20 + 20 * (i // 3)) for i in range(18)]
    stamp = [("stamp", 300, y) for y in (20, 400, 790)]
    r = ge.reading_order(page(spark, left + right + stamp)).first()
    assert r.layout == "TWO_COLUMN" and [c.split("\n")[0] for c in r.columns] == ["l0 l1 l2", "r0 r1 r2"] and "stamp" not in " ".join(r.columns)
    few = ge.reading_order(page(spark, left[:5])).first()
    assert few.layout == "UNKNOWN" and few.columns == ["l0 l1 l2\nl3 l4"]
    one = ge.reading_order(page(spark, left + right[:2])).first()
    assert one.layout == "SINGLE" and len(one.columns) == 1


def test_garbage_clusters(spark):
    words = [("@", 0, 0), ("©", 50, 0), ("§", 100, 0), ("@", 500, 500), ("fine", 30, 0), ("~", 500, 700), ("^", 520, 700)]
    got = ge.garbage_clusters(page(spark, words)).orderBy("cluster").collect()
    assert [(r.cluster, r.n, r.x0, r.x1) for r in got] == [(0, 3, 0.0, 108.0), (5, 2, 500.0, 528.0)]
    low = page(spark, words).withColumn("conf", F.lit(0.1))
    assert [(r.n) for r in ge.garbage_clusters(low, px=600).collect()] == [7]


def test_empty_pages(spark):
    w = page(spark, [("x", 0, 0)]).limit(0)
    assert dr.drafts_of_pages(w, 600.0, 800.0).count() == 0 and ge.reading_order(w).count() == 0 and ge.garbage_clusters(w).count() == 0


def test_questions_go_on_over_pages(spark):
    def page_of(number, words):
        return page(spark, words, number=number).withColumn("word_id", F.col("word_id") + 1000 * number)

    one, tail = question(1, 10, 20) + question(2, 10, 400), [("rest", 30, 20), ("of", 80, 20), ("it", 120, 20), ("(d)", 30, 60)]
    with_tail = tail + question(3, 10, 200)
    parts = {1: one, 2: with_tail, 3: question(4, 10, 12), 5: with_tail, 6: [("figure", 50, 50), ("alone", 120, 50)], 7: with_tail}
    words = None
    for number, w in parts.items():
        words = page_of(number, w) if words is None else words.unionByName(page_of(number, w))
    got = dr.drafts_of_pages(words, 620.0, 800.0).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got)))
    ends = {(r.page, r.question_number): r.span_page_end for r in got}
    # 2 goes on on page 2; 3 does not on page 3, which begins with its marker; page 3 hands 4 on to page 5, the next that was read
    assert ends[1, 2] == 2 and ends[2, 3] is None and ends[3, 4] == 5
    assert ends[5, 3] is None and ends[6, None] is None and ends[7, 3] is None  # a page without markers closes what is open
    stitched = next(r for r in got if r.span_page_end == 2)
    assert (stitched.header_x0, stitched.header_x1, stitched.header_y1) == (5.0, 620.0, 195.0) and stitched.needs_review and stitched.confidence == 0.55
    whole = next(r for r in got if r.page == 6)
    assert (whole.n_cols, whole.x0, whole.y1, whole.invalid_crop) == (0, 0.0, 800.0, False)
    # page 4 was read and is blank: it closes question 4
    read = words.select("job_id", "page").distinct().union(spark.createDataFrame([(1, 4)], "job_id int, page int"))
    got = dr.drafts_of_pages(words, 620.0, 800.0, read).collect()
    assert {(r.page, r.question_number): r.span_page_end for r in got}[3, 4] is None and sum(r.page == 4 for r in got) == 1
    assert dr.drafts_of_pages(words.limit(0), 620.0, 800.0).count() == 0


def test_scan_over_blocks_equals_one_pass(spark):
    import random

    r = random.Random(4)
    rows = [(g, i, r.choice([None, None, r.randint(0, 99)]), r.randint(0, 5)) for g in (1, 2, 3) for i in r.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "g int, at int, v int, n int")
    got = {(x.g, x["at"]): (x.before, x.sum) for x in dr.carried(df, ["g"], "at", {"before": "v"}, {"sum": "n"}, block=7).collect()}
    assert len(got) == len(rows)
    for g in (1, 2, 3):
        last, total = None, 0
        for _, i, v, n in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            assert got[g, i] == (last, total)
            last, total = v if v is not None else last, total + n


def test_missing_numbers_are_traced(spark):
    drafts = [(1, 1, 0, 1, 0, 1, 0.0, 0.0, 100.0, 100.0, False, "1. a"), (1, 1, 1, 3, 0, 1, 0.0, 100.0, 100.0, 300.0, False, "3. b 4. c"), (1, 2, 2, 8, 1, 2, 0.0, 0.0, 100.0, 300.0, False, "8. d 2.5"), (1, 2, 3, None, 1, 2, 0.0, 300.0, 100.0, 400.0, False, None), (1, 2, 4, 9, 1, 2, 0.0, 500.0, 100.0, 600.0, True, "x")]
    d = spark.createDataFrame([(*x, False) for x in drafts], "job_id int, page int, position int, question_number int, col int, n_cols int, x0 double, y0 double, x1 double, y1 double, invalid_crop boolean, text string, needs_review boolean")
    read = spark.createDataFrame([(1, 1, 5, 4, 10.0, 150.0), (1, 1, 6, 5, 500.0, 10.0), (1, 2, 7, 6, 500.0, 10.0), (1, 2, 8, 7, 500.0, 10.0)], "job_id int, page int, word_id long, num int, x double, y double")
    markers, kept = spark.createDataFrame([(1, 4), (1, 6), (1, 7), (1, None)], "job_id int, num int"), spark.createDataFrame([(1, 4), (1, 7)], "job_id int, num int")
    got = {r.expected: r for r in dr.missing_trace(d, read, markers, kept).collect()}
    assert {n: r.stage for n, r in got.items()} == {2: "OCR_MISS", 4: "NOT_SPLIT", 5: "MARKER_MISS", 6: "SEQUENCE_REMOVED", 7: "UNKNOWN"}
    assert [(r.previous, r.next, r.page, r.column, r.merged_into) for r in (got[2], got[4], got[6])] == [(1, 3, 1, "Single", None), (3, 8, 1, "Single", 3), (3, 8, 2, "Single", None)]
    more = {r.expected: (r.previous, r.next, r.stage) for r in dr.missing_trace(d, read, markers, kept, 10).collect()}
    assert more[9] == more[10] == (8, None, "OCR_MISS") and set(more) == {2, 4, 5, 6, 7, 9, 10}
    none = spark.createDataFrame([(2, 1, 0, None, 0, 1, 0.0, 0.0, 1.0, 1.0, False, "x", True)], d.schema)
    assert [(r.expected, r.previous, r.next, r.page) for r in dr.missing_trace(none, read, markers, kept, 2).orderBy("expected").collect()] == [(1, None, None, None), (2, None, None, None)]
    assert dr.missing_trace(none, read, markers, kept).count() == 0
    assert [(r.position, r.numbers) for r in dr.crowded_crops(d).collect()] == [(1, [3, 4])]
    assert [(r.numberless, r.needs_review) for r in dr.review_counts(d).collect()] == [([3], 0)]


@pytest.mark.parametrize("px", [7.0, 30.0])
def test_clusters_equal_pairwise_ones(spark, px):
    import random

    from gradeloom.operators.grid import clusters, points_in_boxes

    r = random.Random(int(px))
    rows = []
    for job in (1, 2):
        for i in range(90):
            x, y = r.uniform(-100, 300), r.uniform(-100, 300)
            rows.append((job, i, x, y, x + r.choice([0, 2, 9, 80]), y + r.choice([0, 2, 9, 60])))
    rows += [(3, i, 10.0, 10.0, 12.0, 12.0) for i in range(300)] + [(3, 400, 12.0 + px, 12.0 + px, 90.0, 90.0), (3, 401, 91.0 + px, 0.0, 92.0 + px, 91.0)]
    df = spark.createDataFrame(rows, "job int, id long, x0 double, y0 double, x1 double, y1 double")
    got = {(x.job, x.id): x.cluster for x in clusters(df, ["job"], "id", px).collect()}
    for job in (1, 2, 3):
        boxes = {i: b for j, i, *b in rows if j == job}
        label = {i: i for i in boxes}
        near = lambda a, b: max(a[0], b[0]) - min(a[2], b[2]) <= px and max(a[1], b[1]) - min(a[3], b[3]) <= px
        changed = True
        while changed:
            changed = False
            for i in boxes:
                least = min(label[k] for k in boxes if near(boxes[i], boxes[k]))
                if least < label[i]:
                    label[i], changed = least, True
        assert {i: got[job, i] for i in boxes} == label
    p = df.select("job", "id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y"))
    b = df.where("id % 9 = 0").select("job", F.col("id").alias("box"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]).union(spark.createDataFrame([(1, 1000, -1e9, -1e9, 1e9, 1e300)], "job int, box long, b_x0 double, b_y0 double, b_x1 double, b_y1 double"))
    holds = F.col("x").between(F.col("b_x0"), F.col("b_x1")) & F.col("y").between(F.col("b_y0"), F.col("b_y1"))
    assert sorted((x.job, x.id, x.box) for x in points_in_boxes(p, b, ["job"], F.col("x"), F.col("y"), holds).collect()) == sorted((x.job, x.id, x.box) for x in p.join(b, "job").where(holds).collect())


def test_figures_go_to_parts_by_overlap_then_nearness(spark):
    import random

    r = random.Random(9)
    rows = lambda n, f: [(1, p, i, *f()) for p in (1, 2, 3) for i in range(n)]
    span = lambda: (y := float(r.randint(0, 900)), y + r.choice([0.0, 5.0, 40.0, 300.0]))
    figures = spark.createDataFrame(rows(30, span), "job_id int, page int, figure_id long, y0 double, y1 double")
    drafts = spark.createDataFrame([(1, p, 10 + i) for p in (1, 2) for i in range(5)], "job_id int, page int, place int")
    texts = spark.createDataFrame([(1, 1, i, float(60 * i), float(60 * i + 20)) for i in range(11)], "job_id int, page int, reading_order int, y0 double, y1 double")
    spans = {(x.page, x.i): x for x in ge.draft_spans(drafts, texts).collect()}
    want = {}
    for f in figures.where("page < 3").collect():
        best = min((-max(0.0, min(f.y1, s.y_max) - max(f.y0, s.y_min)), abs((s.y_min + s.y_max) / 2 - (f.y0 + f.y1) / 2), s.i, s.place) for (p, _), s in spans.items() if p == f.page)
        want[f.page, f.figure_id] = best[-1]
    assert {(x.page, x.figure_id): x.place for x in ge.attach_by_region(figures, drafts, texts).collect()} == want


def test_near_boxes_of_small_groups_are_joined_in_one_pass(spark, monkeypatch):
    """Small groups equal the grid's clusters, with repeated keys; odd and large ones go by the grid."""
    import numpy as np

    from gradeloom.operators import grid

    r, rows = np.random.default_rng(5), []
    for job in range(30):
        for i in range(int(r.integers(1, 60))):
            x, y = r.integers(0, 400, 2)
            rows.append((job, int(r.integers(0, 50)) + 1, float(x), float(y), float(x + r.integers(0, 40)), float(y + r.integers(0, 14))))
    odd = [(90, 1, 0.0, 0.0, 5.0, 5.0), (90, 2, 9.0, 9.0, 4.0, 4.0), (91, 1, 0.0, 0.0, None, 5.0), (91, 2, 1.0, 1.0, 2.0, 2.0), (None, 1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "job int, id long, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda d: sorted((x.job, x.id, x.cluster) for x in d.collect())
    want = pairs(grid.grid_clusters(df, ["job"], "id", 20.0))
    assert pairs(grid.clusters(df, ["job"], "id", 20.0)) == want
    monkeypatch.setattr(grid, "WHOLE", 25)
    assert pairs(grid.clusters(df, ["job"], "id", 20.0)) == want
    wrote = []
    monkeypatch.setattr(grid, "WHOLE", 2000)
    monkeypatch.setattr(grid, "written", lambda d: wrote.append(d) or d)
    assert grid.clusters(df.where("job < 30"), ["job"], "id", 20.0).count() and len(wrote) == 1 and wrote[0].count() == 0


def test_line_starts_deal_out_pages_once(spark):
    import numpy as np

    r, rows = np.random.default_rng(6), []
    for job in range(12):
        for i in range(int(r.integers(1, 80))):
            x, y = float(r.integers(0, 300)), float(r.integers(0, 160)) / 2
            rows.append((job, 1, i % 70, "1.", x, y, x + float(r.integers(0, 40)), y + float(r.integers(-1, 14)), 0.9))
    rows += [(50, 1, 1, "a", None, 1.0, 2.0, 3.0, 0.9), (50, 1, 2, "b", 3.0, None, 4.0, 5.0, 0.9), (50, 1, None, "c", 5.0, 1.0, 6.0, 3.0, 0.9), (50, 1, 4, "d", 9.0, 1.0, 6.0, 3.0, 0.9), (None, 1, 1, "e", 0.0, 0.0, 1.0, 1.0, 0.9)]
    want = []
    for w in rows:
        on = [o for o in rows if o[:2] == w[:2] and w[0] is not None]
        hs = sorted(o[7] - o[5] for o in on if o[5] is not None and o[7] > o[5])
        h = hs[len(hs) // 2] if hs else 20.0
        near = lambda o: None not in (*o[2:8], *w[2:8]) and abs((o[5] + o[7]) / 2 - (w[5] + w[7]) / 2) <= 0.6 * h and o[2] != w[2] and o[6] <= w[4] and w[4] - o[6] < 2 * h  # noqa: B023, E731
        if on and not any(map(near, on)):
            want.append((*w, h))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, ge.line_starts(df).collect()), key=str) == sorted(want, key=str)
    picked = ge.line_starts(df, F.col("word_id") % 3 == 0)
    assert sorted(map(tuple, picked.collect()), key=str) == sorted((w for w in want if w[2] is not None and w[2] % 3 == 0), key=str)
    assert ge.line_starts(df)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert ge.line_starts(df.limit(0)).count() == 0


def many_pages(spark, jobs=12, pages=6):
    """Pages of two columns of questions, some with a number misread by a hundred and a stamp on each; seventy words or so a page."""
    rows = []
    for job in range(jobs):
        for p in range(pages):
            n = 20 * p + 101
            words = [w for k in range(4) for w in question(n + k, 10, 20 + 190 * k)] + [w for k in range(4) for w in question(n + 4 + k, 320, 20 + 190 * k)]
            words = [(f"{n + 102}.", x, y) if (job + p) % 3 == 0 and t == f"{n + 2}." else (t, x, y) for t, x, y in words] + [("stamp", 560, y) for y in (5, 300, 700)]
            rows += [(job, p, 1000 * p + i, t, float(x), float(y), float(x + 8 * len(t)), float(y + 12), 0.9) for i, (t, x, y) in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def shuffled_records(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_words_of_drafts_are_shuffled_once(spark):
    words = many_pages(spark)
    n, before = words.count(), shuffled_records(spark)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = dr.drafts_of_pages(words, 620.0, 800.0)
    rows = sorted(map(tuple, got.drop("text").collect()), key=str)
    moved = sum(k for s, k in shuffled_records(spark).items() if s not in before)
    assert moved < 2 * n, (moved, n)  # words once; numbers that begin a line, drafts and pages are fewer
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    numbers = sorted((r.job_id, r.page, r.question_number) for r in got.collect())
    assert numbers == [(j, p, 20 * p + 101 + k) for j in range(12) for p in range(6) for k in range(8)] and "text" in got.columns
    short = dr.drafts_of_pages(words, 620.0, 800.0, texts=False)
    assert "text" not in short.columns and sorted(map(tuple, short.collect()), key=str) == rows


def test_boxes_meet_words_by_page_as_by_cells(spark):
    import random

    r = random.Random(11)
    rows = [(r.choice([1, 2, 3]), r.choice([1, 2, 7]), i % 150, f"w{i}", x := r.uniform(-50, 700), y := r.uniform(-50, 900), x + r.choice([0.0, 8.0, 300.0]), y + r.choice([-5.0, 0.0, 12.0, 200.0]), 0.9) for i in range(400)]
    rows += [(1, 1, 500, "odd", None, 5.0, 9.0, 9.0, 0.9), (None, 1, 501, "lost", 5.0, 5.0, 9.0, 9.0, 0.9), (1, None, 502, None, 5.0, 5.0, 9.0, 9.0, 0.9), (1, 1, None, "nameless", 5.0, 5.0, 9.0, 9.0, 0.9)]
    boxes = [(j, p, k, i, a, b, a + r.uniform(-20, 400), b + r.uniform(-20, 500)) for j in (1, 2, 3, None) for p in (1, 2, 9) for k in (0, 1) for i in range(5) for a, b in [(r.uniform(-60, 600), r.uniform(-60, 800))]]
    w, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(boxes, "job_id int, page int, col int, place int, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for x in ge.words_in(w, b, "col", "place").collect():
        want.setdefault((x.job_id, x.page, x.col, x.place), []).append((x.wy0, x.word_id, x.text, x.wx0, x.wx1, x.wy1))
    got = ge.with_words(b, w).collect()
    assert len(got) == len(boxes) and sum(len(x.ws) for x in got) > 100
    for x in got:
        assert [v[0] for v in x.ws] == sorted(v[0] for v in x.ws)
        assert sorted(map(tuple, x.ws), key=str) == sorted(want.get((x.job_id, x.page, x.col, x.place), []), key=str)
