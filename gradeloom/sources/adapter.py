"""Assessment tables as views of the star-schema test tables. Each is read when a plan first names it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
#: The number of exams that attempts are dealt to.
EXAMS = 50
# Question types and states, in the order of their ordinals.
TYPES = ["SINGLE_CHOICE", "MULTIPLE_CHOICE", "TRUE_FALSE", "FILL_BLANK", "MATCH_FOLLOWING", "MATRIX_MATCH", "DESCRIPTIVE", "VISUAL"]
EXAM_STATES = ["DRAFT", "SCHEDULED", "LIVE", "CLOSED"]
UPLOAD_STATES = ["PENDING", "UPLOADED", "PROCESSING", "READY", "FAILED"]
PAPER_STATES = ["DRAFT", "PUBLISHED", "ARCHIVED"]


def nth(values: list[str], index):
    """The value at a place that is counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def seconds(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


class Tables:
    """The assessment model over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def answers(self) -> DataFrame:
        correct = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id"), F.col("l_linenumber").alias("line_no"),
            correct.alias("is_correct"), F.col("l_quantity").cast("long").alias("time_spent"), F.col("l_shipdate").alias("saved_at"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        state, urgent = F.col("o_orderstatus"), F.col("o_orderpriority")
        status = (
            F.when((state == "F") & (urgent == "1-URGENT"), "FLAGGED").when(state == "F", "GRADED").when(state == "P", "SUBMITTED").when(urgent == "5-LOW", "NOT_STARTED").otherwise("IN_PROGRESS")
        )
        score = F.when((state == "F") & (urgent != "1-URGENT"), F.col("o_totalprice").cast("decimal(12,2)"))
        handed_in = F.when(state.isin("F", "P"), F.col("o_orderdate") + seconds(F.col("o_orderkey") % 5000))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % EXAMS).alias("exam_id"),
            status.alias("status"), score.alias("score"), F.col("o_orderdate").alias("started_at"), handed_in.alias("submitted_at"),
        )

    @cached_property
    def exams(self) -> DataFrame:
        g = self.raw("orders").groupBy((F.col("o_orderkey") % EXAMS).alias("id")).agg(F.max("o_totalprice").cast("decimal(12,2)").alias("total_marks"), F.min("o_orderdate").alias("opens_at"), F.max("o_orderdate").alias("closes_at"))
        i = F.col("id")
        return g.select("id", "total_marks", "opens_at", "closes_at", F.when(i % 3 == 0, "PAPER").otherwise("TEST").alias("kind"), nth(EXAM_STATES, i % 4).alias("status"), (F.lit(1800) + 600 * (i % 7)).alias("duration_seconds"), (i % 7).alias("created_by"), (i % 25).alias("branch_id"), F.concat(F.lit("Exam "), i.cast("string")).alias("title"))

    @cached_property
    def questions(self) -> DataFrame:
        size = F.col("p_size")
        level = F.when(size <= 16, "EASY").when(size <= 33, "MEDIUM").otherwise("HARD")
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_type").alias("subject"), F.col("p_brand").alias("topic"), level.alias("difficulty"), F.col("p_name").alias("name"), size.alias("size"),
            nth(TYPES, F.col("p_partkey") % 8).alias("type"), (1 + size % 5).cast("decimal(5,2)").alias("marks"), (F.lit(0.25).cast("decimal(5,2)") * (size % 3)).cast("decimal(5,2)").alias("negative_marks"), (size % 10 != 0).alias("is_active"),
        )

    @cached_property
    def exam_questions(self) -> DataFrame:
        """Each question of an exam once; a question's id is its position."""
        pairs = self.raw("lineitem").select((F.col("l_orderkey") % EXAMS).alias("exam_id"), F.col("l_partkey").alias("question_id")).distinct()
        return pairs.withColumn("position", F.col("question_id"))

    @cached_property
    def students(self) -> DataFrame:
        roll = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("R"), F.col("c_custkey").cast("string")))
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("branch_id"), F.col("c_mktsegment").alias("class_label"), F.col("c_name").alias("name"), roll.alias("roll_no"))

    @cached_property
    def branches(self) -> DataFrame:
        deleted = F.when(F.col("n_nationkey") % 6 == 5, F.lit("2024-01-01").cast("timestamp_ntz"))
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("tenant_id"), F.col("n_name").alias("name"), deleted.alias("deleted_at"))

    @cached_property
    def classrooms(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.raw("supplier").select(
            s.alias("id"), F.concat(F.lit("Class "), (s % 12).cast("string")).alias("name"), F.col("s_nationkey").alias("branch_id"), (F.lit(2020) + s % 5).alias("year"),
            nth(list("ABCD"), s % 4).alias("section"), F.when(F.col("s_acctbal") >= 0, nth(["Physics", "Maths", "Biology"], s % 3)).alias("subject"), (s % 7).alias("created_by"),
        )

    @cached_property
    def memberships(self) -> DataFrame:
        c, day = F.col("c_custkey"), F.lit("2020-01-01").cast("timestamp_ntz")
        base = self.raw("customer")
        first = base.select((c % 10).alias("classroom_id"), c.alias("student_id"), (day + seconds(86400 * (c % 1000))).alias("joined_at"))
        more = base.where(c % 7 == 0).select(((c * 3 + 1) % 10).alias("classroom_id"), c.alias("student_id"), (day + seconds(86400 * (c % 900 + 500))).alias("joined_at"))
        return first.unionByName(more)

    @cached_property
    def assignments(self) -> DataFrame:
        s, c, none = F.col("s_suppkey"), F.col("c_custkey"), F.lit(None).cast("long")
        rooms = self.raw("supplier").select((s % EXAMS).alias("exam_id"), (s % 10).alias("classroom_id"), none.alias("student_id"))
        direct = self.raw("customer").where(c % 20 == 0).select((c % EXAMS).alias("exam_id"), none.alias("classroom_id"), c.alias("student_id"))
        return rooms.unionByName(direct)

    @cached_property
    def papers(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.raw("nation").select(n.cast("long").alias("id"), F.col("n_name").alias("title"), nth(PAPER_STATES, n % 3).alias("status"), (n % 7).alias("created_by"), F.col("n_regionkey").alias("tenant_id"))

    @cached_property
    def paper_questions(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.raw("part").select((p % 20).alias("paper_id"), p.alias("question_id"), F.floor(p / 20).cast("long").alias("position"), (1 + F.col("p_size") % 5).cast("decimal(5,2)").alias("marks"))

    @cached_property
    def uploads(self) -> DataFrame:
        d, start = F.col("doc_id"), F.lit("2024-01-01").cast("timestamp_ntz") + seconds(60 * F.col("doc_id"))
        return self.raw("documents").select(
            d.alias("id"), F.when(d % 10 != 9, d % 20).alias("batch_id"), F.floor(d / 20).cast("long").alias("batch_order"), nth(UPLOAD_STATES, d % 5).alias("status"),
            F.concat("source", F.lit("/"), d.cast("string")).alias("storage_key"), (d % 25).alias("branch_id"), start.alias("created_at"), (start + seconds(F.col("n_chars") % 600)).alias("updated_at"),
        )

    @cached_property
    def drafts(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderpriority") < "3", "DISCARDED").otherwise("EDITED")
        return self.raw("orders").select(
            o.alias("id"), (o % 200).alias("job_id"), F.floor(o / 200).cast("long").alias("position"), status.alias("status"), F.when(c % 5 != 0, c % 180 + 1).cast("int").alias("question_number"),
            (c % 7).cast("int").alias("option_count"), (c % 5).cast("int").alias("options_length"), F.concat((o % 300).cast("string"), F.lit(". What is "), F.col("o_orderpriority"), F.lit("?")).alias("text"),
            F.when(c % 3 == 0, F.concat(F.lit("S"), (c % 10).cast("string"))).alias("assigned_subject"), F.when(o % 4 == 0, F.concat(F.lit("E"), (o % 10).cast("string"))).alias("explicit_subject"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        v, ts = F.col("value"), F.col("ts")
        return self.raw("events").select(
            F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type").isin("click", "error"), "EMAIL").otherwise("IN_APP").alias("channel"), ts.alias("created_at"),
            F.when(v > 20, ts + seconds(F.lit(60))).alias("sent_at"), F.when(v < 1, ts).alias("failed_at"), (F.col("user_id") % 6).cast("int").alias("attempt_count"), F.when(v > 10, ts).alias("read_at"),
        )

    @cached_property
    def violations(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "TAB_SWITCH").otherwise(F.upper("event_type"))
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("attempt_id"), kind.alias("type"), F.col("ts").alias("server_ts"))

    @cached_property
    def graded_input(self) -> DataFrame:
        """Answers with a JSON payload, and their questions' type, key and marks: what grading reads."""
        return self._payloads(self.answers)

    @cached_property
    def last_graded_input(self) -> DataFrame:
        """The same of each answer's last write; found before payloads are made, and dealt out by attempt once for all that follows."""
        last = self.answers.repartition("attempt_id").groupBy("attempt_id", "question_id").agg(F.max(F.struct("saved_at", "line_no", "time_spent")).alias("w"))
        return self._payloads(last.select("attempt_id", "question_id", "w.*"))

    def _payloads(self, answers: DataFrame) -> DataFrame:
        q, k, n = F.col("question_id"), F.col("time_spent"), F.col("line_no")
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        t = F.col("type")
        key = (
            F.when(t.isin("SINGLE_CHOICE", "VISUAL"), text('{"correct": ["o', q % 4, '"]}'))
            .when(t == "MULTIPLE_CHOICE", text('{"correct": ["o0", "o', 1 + q % 2, '"]}'))
            .when(t == "TRUE_FALSE", text('{"correct": ', q % 2 == 0, "}"))
            .when(t == "FILL_BLANK", text('{"accepted": ["Paris"], "caseSensitive": ', q % 3 == 0, "}"))
            .when(t == "MATCH_FOLLOWING", F.lit('{"pairs": [{"left": "A", "right": "1"}, {"left": "B", "right": "2"}]}'))
            .when(t == "MATRIX_MATCH", F.lit('{"correctMap": {"R1": ["C1"], "R2": ["C2"]}}'))
            .otherwise(F.lit("{}"))
        )
        match = nth(['[{"left": "A", "right": "1"}, {"left": "B", "right": "2"}]', '[{"left": "A", "right": "2"}, {"left": "B", "right": "2"}]', '[{"left": "A", "right": "1"}, {"left": "A", "right": "1"}]'], k % 3)
        matrix = nth(['{"R1": ["C1"], "R2": ["C2"]}', '{"R1": ["C2"], "R2": ["C2"]}', '{"R1": ["C2"]}'], k % 3)
        given = (
            F.when(n == 6, F.lit("{}"))
            .when(t.isin("SINGLE_CHOICE", "VISUAL") & (n == 5), F.lit('{"selectedOptionId": 3}'))
            .when(t.isin("SINGLE_CHOICE", "VISUAL"), text('{"selectedOptionId": "o', k % 4, '"}'))
            .when((t == "MULTIPLE_CHOICE") & (k % 3 == 0), F.lit('{"selectedOptionIds": []}'))
            .when(t == "MULTIPLE_CHOICE", text('{"selectedOptionIds": ["o', 1 + k % 2, '", "o0", "o0"]}'))
            .when((t == "TRUE_FALSE") & (n == 5), F.lit('{"answer": "true"}'))
            .when(t == "TRUE_FALSE", text('{"answer": ', k % 2 == 0, "}"))
            .when(t == "FILL_BLANK", text('{"text": "', nth(["  paris  ", "Paris", "Lyon", " PARIS"], k % 4), '"}'))
            .when(t == "MATCH_FOLLOWING", text('{"matches": ', match, "}"))
            .when(t == "MATRIX_MATCH", text('{"selections": ', matrix, "}"))
            .otherwise(F.lit('{"text": "an essay"}'))
        )
        rows = answers.join(self.questions.select(F.col("id").alias("question_id"), "type", "marks", "negative_marks"), "question_id")
        return rows.select("attempt_id", "question_id", "line_no", "time_spent", "saved_at", "type", "marks", "negative_marks", key.alias("key"), F.when(n != 7, given).alias("answer_payload"))
