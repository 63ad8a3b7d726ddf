"""Signed callbacks, draws, collations and stored objects on small tables."""

import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from gradeloom.operators import locale as lo
from gradeloom.operators import sequences as sq
from gradeloom.sources import callbacks as cb

JOBS = "job_id long, finished boolean, drafts int"


def test_signatures_equal_hmac(spark):
    bodies = [b"", b"x", "ä€".encode() * 100, bytes(range(256))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary")
    for secret in (b"k", b"long" * 16, b"longer" * 30):
        got = {r.i: r.s for r in df.select("i", cb.hmac_sha256(secret, F.col("b")).alias("s")).collect()}
        assert got == {i: hmac.new(secret, b, hashlib.sha256).hexdigest() for i, b in enumerate(bodies)}


def test_what_becomes_of_calls(spark):
    sign = lambda body: hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    good = json.dumps({"ocrJobId": 1, "overallConfidence": 0.7, "drafts": [{"position": 0, "text": "q", "options": [{"label": "a", "isCorrect": True}, {"label": "b"}], "figures": [{"storageKey": "k", "kind": "F"}], "new": 1}, {"position": 1, "text": None}]})
    bodies = {1: good, 2: good, 3: good.replace(":1,", ":2,", 1), 4: json.dumps({"ocrJobId": 3, "errorMessage": "no pages", "drafts": []}), 5: "{broken", 6: json.dumps({"drafts": []}), 7: json.dumps({"ocrJobId": 9, "drafts": []}), 8: json.dumps({"ocrJobId": 4, "drafts": []}), 9: json.dumps({"ocrJobId": 5, "drafts": []}), 13: json.dumps({"ocrJobId": 6})}
    rows = [(i, b, sign(b)) for i, b in bodies.items()] + [(10, good, None), (11, good, "0" * 64), (12, None, "0" * 64), (14, None, None)]
    calls = spark.createDataFrame(rows, "call_id long, body string, signature string")
    jobs = spark.createDataFrame([(1, False, 0), (2, True, 0), (3, None, None), (4, False, 2), (5, False, 0), (6, False, 0)], JOBS)
    c = cb.checked(calls, jobs, b"s")
    assert {r.call_id: r.outcome for r in c.collect()} == {1: "written", 2: "done", 3: "done", 4: "failed", 5: "malformed", 6: "malformed", 7: "unknown", 8: "done", 9: "written", 10: "unsigned", 11: "forged", 12: "forged", 13: "malformed", 14: "unsigned"}
    assert sorted((r.job_id, r.position, r.text, r.figures) for r in cb.drafts_of_calls(c).collect()) == [(1, 0, "q", 1), (1, 1, None, 0)]
    first = cb.drafts_of_calls(c).where("position = 0").first()
    assert [(o.label, o.is_correct) for o in first.options] == [("a", True), ("b", False)]
    assert [(r.job_id, r.position, r.figure_index, r.storage_key) for r in cb.figures_of_calls(c).collect()] == [(1, 0, 0, "k")]
    assert sorted((r.job_id, r.stage, r.error, r.drafts) for r in cb.job_outcomes(c).collect()) == [(1, "COMPLETED", None, 2), (3, "FAILED", "no pages", 0), (5, "COMPLETED", None, 0)]
    assert cb.refused(c).count() == 8 and cb.checked(calls.limit(0), jobs, b"s").count() == 0


def test_draws_equal_a_greedy_one(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc"), r.choice([1, 2, None])) for i in range(200)] + [(None, "a", 1), (7, "a", 1)]
    df = spark.createDataFrame(rows, "id long, kind string, level int").repartition(6)
    rules = [((F.col("kind") == "a") & (F.col("level") == 1), 4), (F.col("kind") == "a", 0), (F.col("level") == 1, 50), (F.col("kind") == "a", 300), (F.lit(True), 9)]
    plain = [lambda k, v: k == "a" and v == 1, lambda k, v: False, lambda k, v: v == 1, lambda k, v: k == "a", lambda k, v: True]
    of = {}
    for i, k, v in rows:
        if i is not None:
            of.setdefault(i, []).append((k, v))
    taken, want = set(), []
    for n, ((_, count), fits) in enumerate(zip(rules, plain)):
        order = sorted((i for i, kinds in of.items() if i not in taken and any(fits(k, v) for k, v in kinds)), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))[:count]
        taken |= set(order)
        want += [(n, place, i) for place, i in enumerate(order)]
    assert sorted((x.rule, x.place, x.id) for x in sq.draw(df, rules, 3).collect()) == sorted(want)
    assert sq.draw(df.limit(0), rules, 3).count() == 0 and sq.draw(df, [], 3).count() == 0


def test_words_by_collation(spark):
    words = ["zebra", "Äpfel", "apfel", "Apfel", "äpfel", "Zebra", "ähnlich", "b", "B", "résumé", "resume", "Resume"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in lo.sorted_by_locale(df, "w").collect()]
    assert got == ["ähnlich", "apfel", "Apfel", "äpfel", "Äpfel", "b", "B", "resume", "Resume", "résumé", "zebra", "Zebra"]
    groups = {r.w: (r.letters, r.folded, r.same) for r in lo.sort_groups(df, "w").collect()}
    assert groups["äpfel"] == ("Apfel", "Äpfel", 4) and groups["resume"] == ("Resume", "Resume", 3) and groups["b"] == ("B", "B", 2)
    pairs = {(r.w, r.v) for r in lo.equal_words(df, spark.createDataFrame([("ÄPFEL",), ("RÉSUMÉ",), ("x",)], "v string"), "w", "v").collect()}
    assert pairs == {("Äpfel", "ÄPFEL"), ("äpfel", "ÄPFEL"), ("résumé", "RÉSUMÉ")}


def test_groups_of_words_go_letter_by_letter(spark):
    words = ["Einß", "EINSS", "einss", "øre", "Ore", "œuf", "oeuf", "Łódź", "łodz", "Lodz", "İl", "il"]
    groups = {r.w: (r.letters, r.folded, r.same) for r in lo.sort_groups(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert groups["Einß"] == ("Einß", "Einß", 1) and groups["einss"] == ("EINSS", "EINSS", 2)
    assert groups["øre"][2] == groups["œuf"][2] == groups["Lodz"][2] == 1 and groups["Łódź"] == ("Łódź", "Łódź", 2) and groups["łodz"] == ("Łódź", "łodz", 2)
    assert groups["il"][2] == groups["İl"][2] == 2
