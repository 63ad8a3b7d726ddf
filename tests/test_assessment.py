import duckdb
import pytest

import gradeloom.plans.assessment  # noqa: F401
import gradeloom.plans.expected  # noqa: F401
from gradeloom.functions.answer_keys import key_assign, key_parse, key_report, missing_numbers, text_report
from gradeloom.functions.documents import parse_drafts
from gradeloom.functions.grading import grade
from gradeloom.operators.sequences import seeded_shuffle
from gradeloom.plans.registry import QUERIES, SQL
from gradeloom.sources.adapter import TABLES

DATA = "/root/testdata/sf0.001"
CASES = [  # type, key, answer, is_correct, marks (4 for right, -1 for wrong)
    ("SINGLE_CHOICE", '{"correct": ["b"]}', '{"selectedOptionId": "b"}', True, 4),
    ("SINGLE_CHOICE", '{"correct": ["b"]}', '{"selectedOptionId": "a"}', False, -1),
    ("SINGLE_CHOICE", '{"correct": ["b"]}', '{"selectedOptionId": 3}', False, -1),
    ("SINGLE_CHOICE", '{"correct": ["b"]}', None, False, 0),
    ("SINGLE_CHOICE", '{"correct": ["b"]}', "{}", False, 0),
    ("MULTIPLE_CHOICE", '{"correct": ["a", "b"]}', '{"selectedOptionIds": ["b", "a", "a"]}', True, 4),
    ("MULTIPLE_CHOICE", '{"correct": ["a", "b"]}', '{"selectedOptionIds": ["a"]}', False, -1),
    ("MULTIPLE_CHOICE", '{"correct": ["a", "b"]}', '{"selectedOptionIds": []}', False, -1),
    ("TRUE_FALSE", '{"correct": true}', '{"answer": true}', True, 4),
    ("TRUE_FALSE", '{"correct": true}', '{"answer": "true"}', False, -1),
    ("FILL_BLANK", '{"accepted": ["Paris"], "caseSensitive": false}', '{"text": "  paris  "}', True, 4),
    ("FILL_BLANK", '{"accepted": ["Paris"], "caseSensitive": true}', '{"text": "paris"}', False, -1),
    ("FILL_BLANK", '{"accepted": ["Paris"], "caseSensitive": true}', '{"text": "Paris"}', True, 4),
    ("MATCH_FOLLOWING", '{"pairs": [{"left": "A", "right": "1"}, {"left": "B", "right": "2"}]}', '{"matches": [{"left": "A", "right": "1"}, {"left": "B", "right": "2"}]}', True, 4),
    ("MATCH_FOLLOWING", '{"pairs": [{"left": "A", "right": "1"}, {"left": "B", "right": "2"}]}', '{"matches": [{"left": "A", "right": "2"}, {"left": "B", "right": "2"}]}', False, -1),
    ("MATCH_FOLLOWING", '{"pairs": [{"left": "A", "right": "1"}, {"left": "B", "right": "2"}]}', '{"matches": [{"left": "A", "right": "1"}, {"left": "A", "right": "1"}]}', True, 4),
    ("MATRIX_MATCH", '{"correctMap": {"R1": ["C1"], "R2": ["C2"]}}', '{"selections": {"R1": ["C1"], "R2": ["C2"]}}', True, 4),
    ("MATRIX_MATCH", '{"correctMap": {"R1": ["C1"], "R2": ["C2"]}}', '{"selections": {"R1": ["C2"]}}', False, -1),
    ("DESCRIPTIVE", "{}", '{"text": "x"}', None, 0),
]


def test_grading(spark):
    df = spark.createDataFrame([(i, t, k, a) for i, (t, k, a, _, _) in enumerate(CASES)], "i int, type string, key string, answer_payload string").selectExpr("*", "4 AS marks", "1 AS negative_marks")
    graded = grade(df)
    got = {r.i: (r.is_correct, float(r.marks_awarded)) for r in graded.collect()}
    assert got == {i: (c, float(m)) for i, (_, _, _, c, m) in enumerate(CASES)}
    assert "Python" not in graded._jdf.queryExecution().toString()


KEY_TEXTS = [
    (1, "1-A 2-C 3-B 4-D"), (2, "1. A   2) B   3: C   7 → D"), (3, "12-3\n1 TRUE\n2 false"), (4, "1-A 1-C 2-B"), (5, "123\n1 because it is"), (6, "0-A 1-A 1-A 2-B 2-C 4-Z 5-D"), (7, None), (8, "Q1-A Question 2. (B)\n1234-B"),
    (9, "Total Questions: 22\n1 A 2 B"), (10, "ABC1-A (1) B"),
]


def test_answer_keys(spark):
    rows = key_parse(spark.createDataFrame(KEY_TEXTS, "doc_id int, text string")).cache()
    got = {(r.doc_id, r.number): (r.answer, r.state) for r in rows.collect()}
    of = lambda d: {n: a for (x, n), (a, s) in got.items() if x == d and s in ("entry", "duplicate")}
    assert of(1) == {1: "1", 2: "3", 3: "2", 4: "4"}
    assert of(2) == {1: "1", 2: "2", 3: "3", 7: "4"}
    assert of(3) == {12: "3", 1: "TRUE", 2: "FALSE"}
    assert got[(4, 1)] == (None, "conflict") and of(4) == {2: "2"}
    assert not of(5) and not of(7) and not of(10)
    assert of(8) == {1: "1", 2: "2", 1234: "2"} and of(9) == {1: "1", 2: "2"}
    assert got[(6, 0)] == (None, "rejected") and got[(6, 1)] == ("1", "duplicate") and got[(6, 4)] == ("Z", "invalid")
    r = {x.doc_id: x for x in key_report(rows).collect()}[6]
    assert (r.entries, r.starts_at_one, r.missing, r.duplicates, r.conflicts, r.invalid, r.rejected) == (2, True, [2, 3, 4], [1, 2], [2], [4], [0])
    assert {(r.doc_id, r.number) for r in missing_numbers(rows).collect() if r.doc_id == 6} == {(6, 2), (6, 3), (6, 4)}


def test_keys_are_parsed_within_their_rows(spark):
    texts = spark.createDataFrame([*KEY_TEXTS, (6, "5-b 4-zz 4-Z 4-Z"), (None, "1-A 3-C"), (11, "none")], "doc_id int, text string")
    by = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert by(text_report(texts)) == by(key_report(key_parse(texts))) and text_report(texts.limit(0)).count() == 0
    rows = {(r.number, r.answer): (r.n, r.state) for r in key_parse(texts).where("doc_id = 6").collect()}
    assert rows == {(0, None): (1, "rejected"), (1, "1"): (2, "duplicate"), (2, None): (2, "conflict"), (4, "Z"): (3, "invalid"), (4, "zz"): (1, "invalid"), (5, None): (2, "conflict")}
    plan = QUERIES["key_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # texts are made once and parsed where they are


def test_key_assignment(spark):
    parsed = key_parse(spark.createDataFrame([(1, "1-A 2-D 3-B 9-C")], "doc_id int, text string"))
    drafts = [("a", 1, "7. x", 1, 4, 0), ("b", 1, "Q.2 y", None, 2, 0), ("c", 1, "Q.2 z", None, 2, 4), ("d", 1, "no number", None, 0, 0), ("e", 1, "3) w", None, 0, 0)]
    out = {(r.draft_id, r.number): (r.answer, r.state) for r in key_assign(spark.createDataFrame(drafts, "draft_id string, doc_id int, text string, question_number int, option_count int, options_length int"), parsed).collect()}
    assert out == {("a", 1): ("1", "assigned"), ("b", 2): (None, "out_of_range"), ("c", 2): ("4", "assigned"), ("d", None): (None, "unmatched"), ("e", 3): ("2", "assigned"), (None, 9): ("3", "unused")}


def same(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


NAMES = ["topic_reports", "exam_summary", "exam_score_histogram", "exam_question_stats", "exam_report_detail", "student_summary", "class_reports", "attempt_score", "key_parse", "w_gap_neighbours", "s_violation_state", "route_decide", "threshold_sweep", "line_start", "column_split"]


@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    q = con.execute(SQL[name])
    cols = [c[0] for c in q.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(same(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in q.fetchall()), key=str)
    got = sorted((tuple(same(r[c]) for c in sorted(cols)) for r in df.collect()), key=str)
    assert got == want and got


def test_every_query_has_rows_to_expect():
    without = {"seeded_shuffle", "reading_order", "draft_assemble"}
    assert set(QUERIES) - set(SQL) == without  # these have tests on fixtures
    assert not set(SQL) - set(QUERIES)


def test_seeded_shuffle(spark):
    def plain(items, seed):
        """The generator on bits, as text."""
        s, out = seed if seed else 1, list(items)
        for i in range(len(out) - 1, 0, -1):
            s = (s ^ s << 13) % 2**64
            s = s ^ s >> 7
            s = (s ^ s << 17) % 2**64
            j = s % 2**32 % (i + 1)
            out[i], out[j] = out[j], out[i]
        return out

    rows = [(list(range(n)), seed) for n in (0, 1, 5, 40) for seed in (0, 1, -7, 2**62)] + [(None, 3)]
    df = seeded_shuffle(spark.createDataFrame(rows, "items array<int>, seed long"), "items", "seed")
    for r in df.collect():
        assert r.shuffled == (None if r["items"] is None else plain(r["items"], r.seed))


def test_parse_drafts(spark):
    pages = [
        (1, "1. What is the capital of France today?\n(a) Paris\n(b) Rome\n(c) Oslo\n2. Which of these is a metal of note?\n1. Gold\n2. Salt\nSolution: Gold is.\nmore"),
        (2, "Q1. Name it\nQ2. Pick all that apply to this (1) a (2) b (3) c"),
        (3, None),
        (4, "stray line\n(a) lone option\n5) fresh one here 3c c @ 5 c tail"),
    ]
    got = {}
    for r in parse_drafts(spark.createDataFrame(pages, "page int, text string"), "page").collect():
        got.setdefault(r.page, {})[r.position] = (r.text, r.type, r.options, r.solution, r.needs_review)
    assert got[1] == {0: ("What is the capital of France today?", "SINGLE_CHOICE", ["Paris", "Rome", "Oslo"], None, False), 1: ("Which of these is a metal of note?", "SINGLE_CHOICE", ["Gold", "Salt"], "Gold is. more", False)}
    assert got[2] == {0: ("Name it", "DESCRIPTIVE", None, None, False), 1: ("Pick all that apply to this", "MULTIPLE_CHOICE", ["a", "b", "c"], None, False)}
    assert 3 not in got and got[4][0][0] == "" and got[4][1] == ("fresh one here tail", "DESCRIPTIVE", None, None, True)


def test_grades_of_an_exam_count_unanswered_questions_without_a_frame(spark, tmp_path):
    """Ten thousand attempts of one exam with four thousand questions: too many for a row each."""
    from gradeloom.plans.assessment import grades_of_exam
    from gradeloom.sources.adapter import Tables

    n, f = 10_000, str(tmp_path)
    spark.range(n).selectExpr("id * 50 + 2 AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "timestamp_ntz '1995-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority").write.parquet(f"{f}/orders.parquet")
    spark.range(4000).selectExpr("id AS p_partkey", "'red' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.0D AS p_retailprice").write.parquet(f"{f}/part.parquet")
    spark.range(n // 2).selectExpr("id * 50 + 2 AS l_orderkey", "id % 4000 AS l_partkey", "1L AS l_suppkey", "1 AS l_linenumber", "5.0D AS l_quantity", "10.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "timestamp_ntz '1995-02-01' AS l_shipdate").write.parquet(f"{f}/lineitem.parquet")
    g = grades_of_exam(Tables(spark, f), 2)
    rows = g.collect()
    assert len(rows) == n and {r.asked for r in rows} == {4000} and sum(r.correct == 0 for r in rows) >= n // 2
    assert all(r.marks == 0 and r.correct == 0 for r in rows if r.attempt_id >= 50 * (n // 2) + 2)
