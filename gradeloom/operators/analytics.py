"""Rollups of answers and attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of attempts that count as handed in and as graded, and the upper ends of the score buckets.
HANDED_IN, GRADED = ["SUBMITTED", "GRADED", "FLAGGED"], ["GRADED", "FLAGGED"]
BUCKETS = [20, 40, 60, 80]
#: Topics below this percentage are weak.
WEAK_BELOW = 60.0


def rounded(x: Column, places: int) -> Column:
    """To the nearest step, halves upwards."""
    return F.floor(x * F.lit(float(10**places)) + F.lit(0.5)) / F.lit(float(10**places))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") * F.lit(100.0) / whole.cast("double"))


def flag(total: Column, correct: Column) -> Column:
    """How a question behaves, by the share of right answers: the first rule that holds."""
    p = share(correct, total)
    return F.when(p.isNull(), "normal").when(p >= 0.95, "too_easy").when(p <= 0.2, "too_hard").when((total >= 10) & (F.abs(p - 0.5) < 0.1), "ambiguous").otherwise("normal")


def question_stats(answers: DataFrame) -> DataFrame:
    """(question_id, total, correct, avg_time): over answers with a verdict."""
    known = answers.where("is_correct IS NOT NULL")
    return known.groupBy("question_id").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), (F.sum("time_spent").cast("double") / F.count("*")).alias("avg_time"))


def question_report(stats: DataFrame) -> DataFrame:
    """Stored figures of questions: average time to cents of a second, difficulty = 1 - share of right answers."""
    return stats.select("question_id", "total", "correct", rounded(F.col("avg_time"), 2).alias("avg_time_seconds"), rounded(1 - share(F.col("correct"), F.col("total")), 3).alias("difficulty_score"))


def topic_counts(answers: DataFrame, attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """(student_id, subject, topic, total, correct) over answers with a verdict to questions that have both names."""
    q = questions.where("subject <> '' AND topic <> ''").select(F.col("id").alias("question_id"), "subject", "topic")
    a = attempts.select(F.col("id").alias("attempt_id"), "student_id")
    rows = answers.where("is_correct IS NOT NULL").select("attempt_id", "question_id", "is_correct").join(q, "question_id").join(a, "attempt_id")
    return rows.groupBy("student_id", "subject", "topic").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))


def topic_reports(counts: DataFrame, weak_below: float = WEAK_BELOW) -> DataFrame:
    """Percentages of topics; is_weak goes by the unrounded one."""
    p = percent(F.col("correct"), F.col("total"))
    return counts.select("student_id", "subject", "topic", "total", "correct", rounded(p, 2).alias("score_percent"), (p < weak_below).alias("is_weak"))


def subject_performance(topics: DataFrame) -> DataFrame:
    """Topics added up by student and subject; the percentage is weighted by attempts."""
    g = topics.groupBy("student_id", "subject").agg(F.sum("total").alias("attempts"), F.sum("correct").alias("correct"), F.count("*").alias("topics"), F.count_if("is_weak").alias("weak_topics"))
    return g.withColumn("percent", percent(F.col("correct"), F.col("attempts")))


def score_percent(score: Column, total_marks: Column) -> Column:
    """Of an attempt; a missing score is 0 and an exam of less than one mark counts as one mark."""
    return F.coalesce(score, F.lit(0)).cast("double") * F.lit(100.0) / F.greatest(F.lit(1.0), total_marks.cast("double"))


def exam_summary(attempts: DataFrame, exams: DataFrame) -> DataFrame:
    """Counts of each exam's attempts and the average raw score of graded ones (0 if there are none)."""
    graded = F.col("status").isin(GRADED)
    g = attempts.groupBy(F.col("exam_id").alias("__e")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status").isin(HANDED_IN)).alias("s"), F.count_if(graded).alias("g"), F.sum(F.when(graded, F.coalesce("score", F.lit(0)))).alias("sum")
    )
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return exams.join(g, F.col("id") == F.col("__e"), "left").select(F.col("id").alias("exam_id"), zero("n", "total_attempts"), zero("s", "submitted"), zero("g", "graded"), F.coalesce(share(F.col("sum"), F.col("g")), F.lit(0.0)).alias("avg_score"))


def exam_histogram(attempts: DataFrame, exams: DataFrame) -> DataFrame:
    """(exam_id, bucket 0..4, n): graded attempts by percentage; every bucket of every exam is there.

    Here an exam of no marks counts as one mark, one of less than a mark as it is.
    """
    e = exams.select(F.col("id").alias("exam_id"), "total_marks")
    marks = F.when(F.col("total_marks") == 0, F.lit(1.0)).otherwise(F.col("total_marks").cast("double"))
    p = F.coalesce("score", F.lit(0)).cast("double") * F.lit(100.0) / marks
    bucket = reduce(lambda c, i: c.when(p < BUCKETS[i], i), range(1, len(BUCKETS)), F.when(p < BUCKETS[0], 0)).otherwise(len(BUCKETS))
    counts = attempts.where(F.col("status").isin(GRADED)).join(e, "exam_id").groupBy("exam_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    frame = e.select("exam_id", F.explode(F.sequence(F.lit(0), F.lit(len(BUCKETS)))).alias("bucket"))
    return frame.join(counts, ["exam_id", "bucket"], "left").select("exam_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def exam_question_stats(answers: DataFrame, attempts: DataFrame, exam_questions: DataFrame) -> DataFrame:
    """Each question of an exam within that exam: verdicts, right ones, average time, flag."""
    of = attempts.select(F.col("id").alias("attempt_id"), "exam_id")
    known = answers.where("is_correct IS NOT NULL").select("attempt_id", "question_id", "is_correct", "time_spent").join(of, "attempt_id")
    g = known.groupBy("exam_id", "question_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.sum("time_spent").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = exam_questions.join(g, ["exam_id", "question_id"], "left").select("exam_id", "question_id", "position", zero("n").alias("total"), zero("c").alias("correct"), F.coalesce(share(F.col("t"), F.col("n")), F.lit(0.0)).alias("avg_time"))
    return out.withColumn("flag", flag(F.col("total"), F.col("correct")))


def student_summary(students: DataFrame, attempts: DataFrame, exams: DataFrame, topics: DataFrame) -> DataFrame:
    """Attempts of any state, the mean percentage of graded ones (0 if none), weak topics."""
    e = exams.select(F.col("id").alias("exam_id"), "total_marks")
    graded = F.col("status").isin(GRADED)
    # percentages are added as whole billionths, so that their order doesn't matter
    pct = F.when(graded, F.floor(score_percent(F.col("score"), F.col("total_marks")) * F.lit(1e9) + F.lit(0.5)))
    a = attempts.join(e, "exam_id").groupBy(F.col("student_id").alias("__a")).agg(F.count("*").alias("n"), F.count_if(graded).alias("g"), F.sum(pct.cast("decimal(30,0)")).alias("p"))
    w = topics.groupBy(F.col("student_id").alias("__w")).agg(F.count_if("is_weak").alias("weak"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    mean = rounded(share(F.col("p"), F.col("g")) / F.lit(1e9), 6)
    out = students.join(a, F.col("id") == F.col("__a"), "left").join(w, F.col("id") == F.col("__w"), "left")
    return out.select(F.col("id").alias("student_id"), zero("n", "attempts_total"), zero("g", "graded"), F.coalesce(mean, F.lit(0.0)).alias("avg_score"), zero("weak", "weak_topics"))


def exam_report(exam: int, exams: DataFrame, attempts: DataFrame, answers: DataFrame, exam_questions: DataFrame, questions: DataFrame) -> DataFrame:
    """One exam's report: its header and summary beside each of its questions, whose figures are of this exam alone."""
    own = exams.where(F.col("id") == exam)
    taken, asked = attempts.where(F.col("exam_id") == exam), exam_questions.where(F.col("exam_id") == exam)
    head = own.select(F.col("id").alias("exam_id"), "title").join(exam_summary(taken, own), "exam_id")
    stats = exam_question_stats(answers, taken, asked)
    q = questions.select(F.col("id").alias("question_id"), "subject", "topic")
    p = F.when(F.col("total") > 0, rounded(percent(F.col("correct"), F.col("total")), 1))
    rows = stats.join(q, "question_id", "left").select("exam_id", "question_id", "position", "subject", "topic", "total", p.alias("correct_percent"), rounded(F.col("avg_time"), 1).alias("avg_time"), "flag")
    return rows.join(F.broadcast(head), "exam_id")


def student_report(student: int, students: DataFrame, attempts: DataFrame, exams: DataFrame, topics: DataFrame) -> DataFrame:
    """One student's report: name and summary beside each weak topic, percentages to one place; no weak topic gives one row."""
    own = students.where(F.col("id") == student)
    summary = student_summary(own, attempts.where(F.col("student_id") == student), exams, topics.where(F.col("student_id") == student))
    weak = topics.where((F.col("student_id") == student) & F.col("is_weak")).select("student_id", "subject", "topic", rounded(percent(F.col("correct"), F.col("total")), 1).alias("topic_percent"))
    head = own.select(F.col("id").alias("student_id"), "name", "class_label")
    return head.join(summary.select("student_id", "attempts_total", "graded", rounded(F.col("avg_score"), 1).alias("avg_percent"), "weak_topics"), "student_id").join(weak, "student_id", "left")


def ranked_topics(topics: DataFrame, *order: str, weak_only: bool = False) -> DataFrame:
    """Topics of each student in order (``score`` stands for the exact percentage), numbered from 1."""
    rows = topics.where("is_weak") if weak_only else topics
    rows = rows.withColumn("score", percent(F.col("correct"), F.col("total")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("student_id").orderBy(*order)))


def exam_marks(exam_questions: DataFrame, questions: DataFrame, exams: DataFrame) -> DataFrame:
    """(exam_id, total_marks): what an exam's questions add up to, 0 without any."""
    m = exam_questions.join(questions.select(F.col("id").alias("question_id"), "marks"), "question_id").groupBy(F.col("exam_id").alias("__e")).agg(F.sum("marks").alias("m"))
    return exams.join(m, F.col("id") == F.col("__e"), "left").select(F.col("id").alias("exam_id"), F.coalesce("m", F.lit(0)).cast("decimal(18,2)").alias("total_marks"))


def paper_marks(papers: DataFrame, lines: DataFrame) -> DataFrame:
    m = lines.groupBy(F.col("paper_id").alias("__p")).agg(F.sum("marks").alias("m"))
    return papers.join(m, F.col("id") == F.col("__p"), "left").select(F.col("id").alias("paper_id"), F.coalesce("m", F.lit(0)).cast("decimal(18,2)").alias("total_marks"))
