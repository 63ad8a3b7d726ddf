"""Lists and panels of reports. Their formulas: completion = handed in / assigned or attempts, average score % over
graded attempts with a missing score as 0, accuracy = right / answered, weak share = weak / assessed students."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.analytics import GRADED, HANDED_IN, flag, percent, rounded, score_percent, share
from gradeloom.operators.filters import contains_any


@dataclass(frozen=True)
class ReportFilters:
    """What report lists are narrowed by; None stands for no condition. Dates are ISO strings, the end is exclusive."""

    date_from: str | None = None
    date_to: str | None = None
    subject: str | None = None
    topic: str | None = None
    branch: int | None = None
    classroom: int | None = None
    text: str | None = None

    def dates(self, df: DataFrame, column: str) -> DataFrame:
        if self.date_from is not None:
            df = df.where(F.col(column) >= F.lit(self.date_from).cast("timestamp_ntz"))
        return df if self.date_to is None else df.where(F.col(column) < F.lit(self.date_to).cast("timestamp_ntz"))

    def equal(self, df: DataFrame, **columns) -> DataFrame:
        for name, column in columns.items():
            if (v := getattr(self, name)) is not None:
                df = df.where(F.col(column) == v)
        return df

    def search(self, df: DataFrame, *columns: str) -> DataFrame:
        return df if self.text is None else df.where(contains_any(self.text, *columns))


NONE = ReportFilters()


def _pct(part, whole, places: int = 1) -> Column:
    """A rounded percentage, 0 of nothing."""
    return F.coalesce(rounded(percent(part, whole), places), F.lit(0.0))


def _mean_score() -> Column:
    """Mean percentage of graded attempts in a group with score and total_marks; whole billionths are added."""
    graded = F.col("status").isin(GRADED)
    p = F.when(graded, F.floor(score_percent(F.col("score"), F.col("total_marks")) * F.lit(1e9) + F.lit(0.5)).cast("decimal(30,0)"))
    return F.coalesce(rounded(share(F.sum(p), F.count_if(graded)) / F.lit(1e9), 1), F.lit(0.0))


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).alias(c)


def expand_assignments(assignments: DataFrame, memberships: DataFrame) -> DataFrame:
    """(exam_id, student_id), once each: students assigned directly or through a classroom."""
    direct = assignments.where("student_id IS NOT NULL").select("exam_id", "student_id")
    rooms = assignments.where("classroom_id IS NOT NULL").select("exam_id", "classroom_id").distinct()
    return direct.union(rooms.join(memberships.select("classroom_id", "student_id"), "classroom_id").select("exam_id", "student_id")).distinct()


def overview(exams: DataFrame, attempts: DataFrame, topics: DataFrame, stats: DataFrame, students: DataFrame, classrooms: DataFrame) -> DataFrame:
    """Nine figures in one row: each table is counted once, and the one-row results are set side by side."""
    e = exams.agg(F.count("*").alias("exams"), F.count_if(F.col("status") == "LIVE").alias("live_exams"))
    marks = exams.select(F.col("id").alias("exam_id"), "total_marks")
    a = attempts.join(marks, "exam_id").agg(F.count("*").alias("attempts"), _mean_score().alias("avg_score_percent"))
    t = topics.agg(F.count_if("is_weak").alias("weak_topics"))
    s = stats.agg(F.count("*").alias("tracked_questions"), _pct(F.sum("correct"), F.sum("total")).alias("avg_accuracy_percent"))
    return e.crossJoin(a).crossJoin(t).crossJoin(s).crossJoin(students.agg(F.count("*").alias("students"))).crossJoin(classrooms.agg(F.count("*").alias("classes")))


def exam_list(exams: DataFrame, attempts: DataFrame, assigned: DataFrame, answers: DataFrame, filters: ReportFilters = NONE) -> DataFrame:
    """Per exam: assigned students, attempts, handed in, graded, completion of the assigned, average score and time."""
    kept = filters.search(filters.equal(filters.dates(exams, "opens_at"), branch="branch_id"), "title")
    marks = kept.select(F.col("id").alias("exam_id"), "total_marks")
    spent = answers.groupBy("attempt_id").agg(F.sum("time_spent").alias("spent"))
    taken = attempts.join(marks, "exam_id").join(spent, F.col("id") == F.col("attempt_id"), "left")
    g = taken.groupBy("exam_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status").isin(HANDED_IN)).alias("submitted"), F.count_if(F.col("status").isin(GRADED)).alias("graded"), _mean_score().alias("avg_score_percent"), rounded(share(F.sum("spent"), F.count("spent")), 1).alias("avg_time_seconds")
    )
    to = assigned.groupBy("exam_id").agg(F.count("*").alias("assigned"))
    out = kept.select(F.col("id").alias("exam_id"), "title").join(g, "exam_id", "left").join(to, "exam_id", "left")
    out = out.select("exam_id", "title", *[_zero(c) for c in ("assigned", "attempts", "submitted", "graded")], F.coalesce("avg_score_percent", F.lit(0.0)).alias("avg_score_percent"), F.coalesce("avg_time_seconds", F.lit(0.0)).alias("avg_time_seconds"))
    return out.withColumn("completion_percent", _pct(F.col("submitted"), F.col("assigned")))


def student_list(students: DataFrame, attempts: DataFrame, exams: DataFrame, topics: DataFrame, filters: ReportFilters = NONE) -> DataFrame:
    kept = filters.search(filters.equal(students, branch="branch_id"), "name", "roll_no")
    marks = exams.select(F.col("id").alias("exam_id"), "total_marks")
    a = attempts.join(marks, "exam_id").groupBy("student_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status").isin(HANDED_IN)).alias("submitted"), F.count_if(F.col("status").isin(GRADED)).alias("graded"), _mean_score().alias("avg_percent"))
    t = topics.groupBy("student_id").agg(F.sum("total").alias("answered"), _pct(F.sum("correct"), F.sum("total")).alias("accuracy_percent"), F.count_if("is_weak").alias("weak_topics"))
    out = kept.select(F.col("id").alias("student_id"), "name").join(a, "student_id", "left").join(t, "student_id", "left")
    return out.select("student_id", "name", *[_zero(c) for c in ("attempts", "submitted", "graded", "answered", "weak_topics")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_percent", "accuracy_percent")])


def student_trend(attempts: DataFrame, exams: DataFrame, answers: DataFrame) -> DataFrame:
    """Graded attempts of each student in order of time: percentage, total and average time, accuracy."""
    e = exams.select(F.col("id").alias("exam_id"), "title", "total_marks")
    a = answers.groupBy("attempt_id").agg(F.sum("time_spent").alias("t"), F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.count("is_correct").alias("k"))
    rows = attempts.where(F.col("status").isin(GRADED)).join(e, "exam_id").join(a, F.col("id") == F.col("attempt_id"), "left")
    step = F.row_number().over(Window.partitionBy("student_id").orderBy("started_at", "id"))
    return rows.select(
        "student_id", F.col("id").alias("attempt_id"), "title", step.alias("step"), rounded(score_percent(F.col("score"), F.col("total_marks")), 1).alias("score_percent"),
        F.coalesce("t", F.lit(0)).alias("total_time"), F.coalesce(rounded(share(F.col("t"), F.col("n")), 1), F.lit(0.0)).alias("avg_time"), F.coalesce(rounded(percent(F.col("c"), F.col("k")), 1), F.lit(0.0)).alias("accuracy_percent"),
    )


def topic_rollup(topics: DataFrame, weak_only: bool = False, filters: ReportFilters = NONE) -> DataFrame:
    """Per subject and topic over students: assessed, mean percentage, accuracy, weak students and their share."""
    kept = filters.search(filters.equal(topics, subject="subject", topic="topic"), "subject", "topic")
    score = F.floor(percent(F.col("correct"), F.col("total")) * F.lit(1e9) + F.lit(0.5)).cast("decimal(30,0)")
    g = kept.groupBy("subject", "topic").agg(F.count("*").alias("assessed"), rounded(share(F.sum(score), F.count("*")) / F.lit(1e9), 1).alias("avg_score_percent"), _pct(F.sum("correct"), F.sum("total")).alias("accuracy_percent"), F.count_if("is_weak").alias("weak_students"))
    g = g.withColumn("weak_share_percent", _pct(F.col("weak_students"), F.col("assessed")))
    return g.where("weak_students > 0") if weak_only else g


def question_list(stats: DataFrame, questions: DataFrame, filters: ReportFilters = NONE) -> DataFrame:
    kept = filters.search(filters.equal(questions, subject="subject", topic="topic"), "name")
    rows = kept.join(stats, F.col("id") == F.col("question_id"))
    return rows.select("id", "subject", "topic", "difficulty", "total", _pct(F.col("correct"), F.col("total")).alias("correct_percent"), rounded(F.col("avg_time"), 1).alias("avg_time"), flag(F.col("total"), F.col("correct")).alias("flag"))


def class_list(classrooms: DataFrame, memberships: DataFrame, assignments: DataFrame, attempts: DataFrame, exams: DataFrame) -> DataFrame:
    """Per classroom: students, exams assigned to it, its students' attempts at these, completion, average percentage."""
    members = memberships.select("classroom_id", "student_id").distinct()
    rooms = assignments.where("classroom_id IS NOT NULL").select("classroom_id", "exam_id").distinct()
    marks = exams.select(F.col("id").alias("exam_id"), "total_marks")
    tried = attempts.join(marks, "exam_id").join(rooms, "exam_id").join(members, ["classroom_id", "student_id"], "left_semi")
    a = tried.groupBy("classroom_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status").isin(HANDED_IN)).alias("submitted"), _mean_score().alias("avg_percent"))
    m, r = members.groupBy("classroom_id").agg(F.count("*").alias("students")), rooms.groupBy("classroom_id").agg(F.count("*").alias("exams_assigned"))
    out = classrooms.select(F.col("id").alias("classroom_id"), "name").join(m, "classroom_id", "left").join(r, "classroom_id", "left").join(a, "classroom_id", "left")
    out = out.select("classroom_id", "name", *[_zero(c) for c in ("students", "exams_assigned", "attempts", "submitted")], F.coalesce("avg_percent", F.lit(0.0)).alias("avg_percent"))
    return out.withColumn("completion_percent", _pct(F.col("submitted"), F.col("students") * F.col("exams_assigned")))


def dashboard(exams: DataFrame, attempts: DataFrame, uploads: DataFrame, drafts: DataFrame, students: DataFrame, classrooms: DataFrame, questions: DataFrame, papers: DataFrame, notifications: DataFrame, topics: DataFrame, now: str) -> DataFrame:
    """Counts of the dashboard and the latest opening of a live exam, in one row; one pass over each table."""
    t = F.lit(now).cast("timestamp_ntz")
    day, is_ = F.date_trunc("day", t), lambda s: F.col("status") == s
    parts = [
        exams.agg(F.count_if(is_("LIVE")).alias("live_exams"), F.count_if(is_("SCHEDULED")).alias("scheduled_exams"), F.count_if((F.col("opens_at") <= t) & (F.col("closes_at") >= day)).alias("open_today"), F.max(F.when(is_("LIVE"), F.col("opens_at"))).alias("latest_opening")),
        attempts.agg(F.count_if(is_("IN_PROGRESS")).alias("running_attempts"), F.count_if(is_("SUBMITTED")).alias("awaiting_grading"), F.count_if(is_("FLAGGED")).alias("flagged_attempts"), F.count_if((F.col("submitted_at") >= day - F.expr("INTERVAL 7 DAYS")) & (F.col("submitted_at") < day)).alias("submitted_last_week")),
        uploads.agg(F.count_if(is_("PROCESSING")).alias("uploads_processing"), F.count_if(is_("FAILED")).alias("uploads_failed")),
        drafts.agg(F.count_if(F.col("status").isin("PENDING", "EDITED")).alias("drafts_to_review")),
        students.agg(F.count("*").alias("students")),
        classrooms.agg(F.count("*").alias("classrooms")),
        questions.agg(F.count_if("is_active").alias("active_questions")),
        papers.agg(F.count_if(is_("PUBLISHED")).alias("published_papers")),
        notifications.agg(F.count_if(F.col("read_at").isNull()).alias("unread_notifications")),
        topics.agg(F.count_if("is_weak").alias("weak_topics")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order that ends with a unique key."""
    return df.orderBy(*order).limit(n)


def ordinal(column: str, values: list[str]) -> Column:
    """An enum's place in its declaration, for sorting; unknown values and null come last."""
    return F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))
