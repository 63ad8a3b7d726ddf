"""The registered assessment queries: operators with production parameters over the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions import answer_keys as ak
from gradeloom.functions import documents as doc
from gradeloom.functions.grading import grade
from gradeloom.operators import analytics as an
from gradeloom.operators import authoring as au
from gradeloom.operators import drafts as dr
from gradeloom.operators import filters as fi
from gradeloom.operators import geometry as ge
from gradeloom.operators import locale as lo
from gradeloom.operators import reports as re
from gradeloom.operators import routing as ro
from gradeloom.operators import sequences as sq
from gradeloom.operators import state as st
from gradeloom.plans.registry import plan
from gradeloom.sources import adapter
from gradeloom.sources import callbacks as cb
from gradeloom.sources.store import dealt, written

c, lit = F.col, F.lit
FLAGSHIP = "topic_reports"
NOW = "1997-01-01"


def topics(t):
    return an.topic_reports(an.topic_counts(t.answers, t.attempts, t.questions))


def ts(text):
    return lit(text).cast("timestamp_ntz")


# --- scans, filters, projections
plan("scan_predicate", lambda t: t.attempts.where((c("status") == "SUBMITTED") & (c("exam_id") == 4)).select("id", "student_id"))
plan("point_lookup", lambda t: fi.lookup(t.exams, id=17).select("id", "title", "duration_seconds"))
plan("paged_scan", lambda t: fi.page_of(t.students.where("class_label = 'BUILDING'").select("id", "name"), c("name"), c("id"), limit=50, offset=20))
plan("f_tenant_scope", lambda t: fi.through_tenant(t.students, t.branches, 1).select("id", "branch_id"))
plan("f_role_scope", lambda t: fi.role_scope(t.exams, "TEACHER", 3, branch=10).select("id", "title"))
plan("f_in_list", lambda t: t.attempts.where(c("status").isin("SUBMITTED", "GRADED") & c("exam_id").isin(1, 2, 3)).select("id", "status"))
plan("f_not_in", lambda t: fi.without_related(t.questions, t.exam_questions.where("exam_id = 7"), "question_id").select("id"))
plan("f_null_checks", lambda t: t.notifications.where(c("sent_at").isNull() & c("read_at").isNotNull() & (c("channel") != "EMAIL")).select("id", "user_id"))
plan("f_range", lambda t: t.attempts.where((c("started_at") >= ts("1995-01-01")) & (c("started_at") < ts("1996-01-01")) & (c("score") > 1000)).select("id", "exam_id"))
plan("f_ilike", lambda t: t.questions.where(fi.contains_any("BRASS", "name", "subject") | fi.contains_any("red", "name")).select("id", "name"))
plan("f_ci_equals", lambda t: t.classrooms.where(fi.same_text("name", "cLASS 3") | fi.same_text("subject", None)).select("id", "name"))
plan("f_nested_bool", lambda t: t.students.where(((c("branch_id") < 5) | (c("branch_id") > 20)) & ((c("class_label") == "BUILDING") | c("roll_no").isNull())).select("id"))
plan("f_not_or", lambda t: t.uploads.where(c("batch_id").isNull() & ~((c("status") == "READY") | (c("branch_id") == 4) | c("storage_key").startswith("web/"))).select("id", "status"))
plan("f_exists_none", lambda t: fi.with_presence(t.students, t.attempts, "student_id", "id", "has_attempts").select("id", "has_attempts"))
plan("f_col_arith", lambda t: st.expired_attempts(t.attempts, t.exams, NOW).select("id"))
plan("p_denorm", lambda t: t.attempts.where("exam_id = 5").join(t.exams.select(c("id").alias("exam_id"), "title", "total_marks"), "exam_id").join(t.students.select(c("id").alias("student_id"), c("name").alias("student"), "class_label"), "student_id").select("id", "status", "title", "total_marks", "student", "class_label"))
plan("p_coalesce_default", lambda t: t.attempts.join(t.students.where("branch_id < 20").select(c("id").alias("student_id"), "name"), "student_id", "left").select("id", F.coalesce("score", lit(0)).cast("decimal(12,2)").alias("score"), F.coalesce("name", lit("(missing)")).alias("name")))
plan("p_case_state", lambda t: t.uploads.select("id", au.upload_state(c("status")).alias("state")))
plan("p_sanitize", lambda t: t.graded_input.select("attempt_id", "question_id", "line_no", "time_spent", "type", fi.sanitized(c("type"), c("key")).alias("payload")))
plan("p_config_overlay", lambda t: t.raw("events").select(c("event_id").alias("id"), fi.overlay({"k": 50, "tabSwitch": 3}, c("props")).alias("m")).select("id", c("m")["k"].cast("int").alias("k"), c("m")["tabSwitch"].cast("int").alias("tab_switch")))
plan("p_precedence3", lambda t: t.drafts.select("id", fi.first_set("explicit_subject", "assigned_subject", F.concat(lit("D"), (c("job_id") % 3).cast("string"))).alias("subject")))
plan("p_recommend", lambda t: topics(t).where("is_weak").select("student_id", "subject", "topic", F.format_string("Revise %s — currently %d%% correct", c("topic"), F.floor(c("score_percent") + 0.5)).alias("for_staff"), F.format_string("Focus on %s — current score %d%%", c("topic"), F.floor(c("score_percent") + 0.5)).alias("for_student")))

# --- joins
plan("j_inner_expired", lambda t: st.expired_attempts(t.attempts, t.exams, NOW).select("id", "exam_id"))
plan("j_answers_questions", lambda t: t.answers.join(t.attempts.where("exam_id = 9").select(c("id").alias("attempt_id")), "attempt_id").join(t.questions.select(c("id").alias("question_id"), "subject", "topic"), "question_id").select("attempt_id", "line_no", "subject", "topic", "time_spent"))
plan("j_left_map_default", lambda t: t.attempts.join(t.exams.where("id % 5 <> 0").select(c("id").alias("exam_id"), "title", "duration_seconds"), "exam_id", "left").select("id", F.coalesce("title", lit("(missing)")).alias("title"), F.coalesce("duration_seconds", lit(0)).cast("long").alias("duration_seconds")))
plan("j_left_meta", lambda t: an.question_stats(t.answers).join(t.questions.where("is_active").select(c("id").alias("question_id"), "topic"), "question_id", "left").select("question_id", "total", F.coalesce("topic", lit("")).alias("topic")))
plan("j_left_result", lambda t: t.answers.join(t.exam_questions.where("exam_id = 3").select("question_id", "position").distinct(), "question_id", "left").select("attempt_id", "question_id", "line_no", "time_spent", F.coalesce(c("position").cast("string"), lit("")).alias("position")))


def graded(t):
    return grade(t.last_graded_input)


def grades_of_exam(t, exam):
    """For every attempt of the exam: its questions, the right ones and the marks.

    A question without an answer is blank, which is not right and gives no marks. So only answers are graded, and
    questions that an attempt leaves out are counted: attempts are never multiplied by questions.
    """
    q = t.questions.select(c("id").alias("question_id"), "type", "marks", "negative_marks")
    asked = t.exam_questions.where(c("exam_id") == exam).join(q, "question_id")
    taken = t.attempts.where(c("exam_id") == exam).groupBy(c("id").alias("attempt_id")).agg(F.count("*").alias("times"))
    given = t.graded_input.join(taken.select("attempt_id"), "attempt_id", "left_semi")
    given = sq.latest(given, ["attempt_id", "question_id"], F.desc("saved_at"), F.desc("line_no"), F.desc("time_spent")).select("attempt_id", "question_id", "key", "answer_payload")
    marked = grade(given.join(asked, "question_id")).groupBy("attempt_id").agg(F.count_if("is_correct").alias("correct"), F.sum("marks_awarded").alias("marks"))
    every = taken.crossJoin(F.broadcast(asked.agg(F.count("*").alias("questions")))).where("questions > 0").join(marked, "attempt_id", "left")  # one row is broadcast
    of = lambda n: F.coalesce(n, lit(0)) * c("times")
    return every.select("attempt_id", of(c("questions")).alias("asked"), of(c("correct")).alias("correct"), of(c("marks")).cast("decimal(18,2)").alias("marks"))


plan("j_left_grade", lambda t: grades_of_exam(t, 2))
plan("j_semi_some", lambda t: fi.with_related(t.branches, t.students.join(t.attempts.where("status = 'FLAGGED'").select("student_id"), c("id") == c("student_id"), "left_semi"), "branch_id").select("id"))
plan("j_anti_none", lambda t: fi.without_related(t.attempts, t.answers, "attempt_id").select("id"))
plan("j_anti_present", lambda t: t.questions.where("subject = 'ECONOMY'").join(t.paper_questions.where("paper_id < 15").select("question_id"), c("id") == c("question_id"), "left_anti").select("id"))
plan("j_semi_valid", lambda t: fi.with_related(t.drafts, t.uploads, "id", key="job_id").select("id", "job_id"))
plan("j_update_from", lambda t: t.exams.select("id", F.when(c("id") >= 10, c("branch_id")).alias("own"), c("created_by")).join(t.students.select(c("id").alias("created_by"), c("branch_id").alias("theirs")), "created_by", "left").select("id", F.coalesce("own", "theirs").cast("long").alias("branch_id")))
plan("j_self_dedupe", lambda t: sq.latest(t.memberships, ["student_id"], F.desc("joined_at"), F.desc("classroom_id")).select("student_id", "classroom_id"))
plan("j_cross_insert", lambda t: au.upserted_rows(t.attempts.select("exam_id", "student_id", "status"), t.exams.select(c("id").alias("exam_id")).crossJoin(F.broadcast(t.students.agg(F.min("id").alias("student_id")))).withColumn("status", lit("NOT_STARTED")), "exam_id", "student_id").groupBy("status").agg(F.count("*").alias("n")))
plan("j_aligned_zip", lambda t: t.exams.agg(F.count("*").alias("exams")).crossJoin(t.students.agg(F.count("*").alias("students"))).crossJoin(t.questions.agg(F.count_if("is_active").alias("questions"))))

# --- rollups and reports
plan("question_stats", lambda t: an.question_report(an.question_stats(t.answers)))
plan("topic_reports", topics)
plan("subject_performance", lambda t: an.subject_performance(topics(t)))
plan("exam_summary", lambda t: an.exam_summary(t.attempts, t.exams))
plan("exam_score_histogram", lambda t: an.exam_histogram(t.attempts, t.exams))
plan("exam_question_stats", lambda t: an.exam_question_stats(t.answers, t.attempts, t.exam_questions))
plan("question_flag", lambda t: an.question_stats(t.answers).select("question_id", an.flag(c("total"), c("correct")).alias("flag")))
plan("student_summary", lambda t: an.student_summary(t.students, t.attempts, t.exams, topics(t)))
plan("weak_topics", lambda t: an.ranked_topics(topics(t), "score", "subject", "topic", weak_only=True).select("student_id", "subject", "topic", "rank"))
plan("student_topics", lambda t: an.ranked_topics(topics(t), "subject", "score", "topic").select("student_id", "subject", "topic", "rank"))
plan("question_stat_lookup", lambda t: an.question_stats(t.answers.where("question_id = 17")).select("question_id", "total", "correct"))
plan("exam_report_detail", lambda t: an.exam_report(11, t.exams, t.attempts, t.answers, t.exam_questions, t.questions))
plan("student_report_detail", lambda t: an.student_report(42, t.students, t.attempts, t.exams, topics(t)))
plan("reports_overview", lambda t: re.overview(t.exams, t.attempts, topics(t), an.question_stats(t.answers), t.students, t.classrooms))
plan("exam_reports", lambda t: re.exam_list(t.exams, t.attempts, re.expand_assignments(t.assignments, t.memberships), t.answers, re.ReportFilters(date_to="2000-01-01", text="exam")))
plan("student_reports", lambda t: re.student_list(t.students, t.attempts, t.exams, topics(t), re.ReportFilters(text="r1")))
plan("student_trend", lambda t: re.student_trend(t.attempts, t.exams, t.answers))
plan("topic_rollup", lambda t: re.topic_rollup(topics(t)))
plan("topic_rollup_weak", lambda t: re.topic_rollup(topics(t), weak_only=True, filters=re.ReportFilters(subject="ECONOMY")))
plan("question_reports", lambda t: re.question_list(an.question_stats(t.answers), t.questions, re.ReportFilters(text="RING")))
plan("class_reports", lambda t: re.class_list(t.classrooms, t.memberships, t.assignments, t.attempts, t.exams))
plan("attempt_score", lambda t: graded(t).groupBy("attempt_id").agg(F.greatest(F.sum("marks_awarded"), lit(0)).cast("decimal(18,2)").alias("score"), F.bool_or((c("type") == "DESCRIPTIVE") & c("answer_payload").isNotNull() & (c("answer_payload") != "{}")).alias("descriptive_pending")))
plan("exam_total_marks", lambda t: an.exam_marks(t.exam_questions, t.questions, t.exams))
plan("paper_total_marks", lambda t: an.paper_marks(t.papers, t.paper_questions))
plan("drafts_by_status", lambda t: au.drafts_by_status(t.drafts, 3))
plan("job_finalised", lambda t: au.finalised_jobs(t.drafts))
plan("batch_list", lambda t: au.batch_list(t.uploads, t.drafts))
plan("batch_progress", lambda t: au.batch_progress(t.uploads))
plan("job_progress", lambda t: t.uploads.select("id", au.progress_percent(c("status"), c("batch_order") % 7, c("id") % 9).alias("percent")))
plan("paper_summary", lambda t: au.paper_summary(t.papers))
plan("composition_summary", lambda t: au.composition(t.papers, t.paper_questions, t.exams.select((c("id") % 9).alias("paper_id"))))
plan("paper_rows", lambda t: au.counted(t.papers, {"questions": (t.paper_questions, "paper_id")}).join(au.subject_names(t.paper_questions, t.questions, t.papers.where("id % 4 = 0").select(c("id").alias("paper_id"), lit("General").alias("subject"))), c("id") == c("paper_id"), "left").select("id", "title", "questions", F.coalesce("subjects", lit("")).alias("subjects")))
plan("classroom_rows", lambda t: au.counted(t.classrooms, {"students": (t.memberships, "classroom_id"), "assignments": (t.assignments, "classroom_id")}).select("id", "name", "students", "assignments"))
plan("upload_rows", lambda t: au.counted(t.uploads, {"drafts": (t.drafts, "job_id"), "approved": (t.drafts.where("status = 'APPROVED'"), "job_id")}).select("id", "drafts", "approved"))
plan("classroom_facets", lambda t: au.facets(t.classrooms))
plan("dashboard_summary", lambda t: re.dashboard(t.exams, t.attempts, t.uploads, t.drafts, t.students, t.classrooms, t.questions, t.papers, t.notifications, topics(t), NOW))
plan("notification_counts", lambda t: t.notifications.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(c("read_at").isNull()).alias("unread")))
plan("violation_counts", lambda t: t.violations.groupBy("attempt_id", "type").agg(F.count("*").alias("n")))
plan("violation_totals", lambda t: t.violations.groupBy("attempt_id").agg(F.count("*").alias("n")))
plan("status_counts_ladder", lambda t: t.attempts.agg(F.count("*").alias("n0"), F.count_if(c("score").isNotNull()).alias("n1"), F.count_if(c("score").isNotNull() & (c("exam_id") < 25)).alias("n2"), F.count_if(c("score").isNotNull() & (c("exam_id") < 25) & (c("score") > 1000)).alias("n3")))

# --- sequences, order, sets
plan("w_batch_sequence", lambda t: sq.numbered_in_ranges(t.drafts.withColumn("batch", c("job_id") % 20), ["batch"], "position", 16, c("position"), c("id")).select("batch", "id", "seq"))
plan("w_positions", lambda t: sq.numbered(t.drafts, ["job_id"], c("question_number").asc_nulls_last(), c("position"), c("id"), name="place", start=0).select("job_id", "id", "place"))
plan("w_append_pos", lambda t: sq.appended(t.questions.where("subject = 'PROMO'").select((c("id") % 25).alias("paper_id"), c("id").alias("question_id")), t.paper_questions, "paper_id", c("question_id")).select("paper_id", "question_id", "position"))
plan("w_draft_position", lambda t: sq.numbered(t.drafts.withColumns({"page": c("id") % 5, "side": c("question_number") % 2}), ["job_id"], c("page"), c("side").asc_nulls_first(), c("position"), c("id"), name="place", start=0).select("job_id", "id", "place"))
plan("w_roll_numbers", lambda t: sq.roll_numbers(t.students, "class_label", F.concat(lit("24"), F.upper(F.substring("class_label", 1, 2)), lit("A")), c("id")).select("id", "roll_no"))
plan("w_gap_neighbours", lambda t: sq.gaps(t.drafts, "job_id", "question_number").select("job_id", "missing", "previous", "next"))
plan("w_monotone_run", lambda t: sq.rising(t.drafts, "job_id", "question_number", c("position"), c("id")).select("id", "job_id", "question_number"))
plan("w_latest_per_key", lambda t: sq.latest(t.memberships, ["student_id"], F.desc("joined_at"), F.desc("classroom_id")).select("student_id", "classroom_id", "joined_at"))
plan("w_after_marker", lambda t: sq.until_marker(t.drafts, "job_id", c("status") == "DISCARDED", c("position"), c("id")).select("id", "after_marker"))


def placed_exams(t):
    """Exams numbered by state, opening time (none last) and id; numbered in ranges of a month, so no task sorts them all."""
    at = re.ordinal("status", adapter.EXAM_STATES).cast("long") * 10**11 + F.coalesce(F.unix_seconds(c("opens_at").cast("timestamp")), lit(10**11 - 1))
    return sq.numbered_in_ranges(t.exams.withColumns({"all": lit(0), "at": at}), ["all"], "at", 30 * 86_400, c("at"), c("opens_at").asc_nulls_last(), c("id"), name="place")


plan("sort_enum_nulls", lambda t: placed_exams(t).select("id", c("place").cast("int").alias("place")))
plan("topk_review_queue", lambda t: re.top(t.drafts.where("status IN ('PENDING', 'EDITED')"), 6, F.desc("position"), F.desc("id")).select("id", "job_id"))
plan("topk_todays_exams", lambda t: re.top(t.exams.where((c("opens_at") <= ts(NOW)) & (c("closes_at") >= ts(NOW))), 6, re.ordinal("status", adapter.EXAM_STATES), c("opens_at"), c("id")).select("id", "status"))
plan("top1_latest_published", lambda t: t.exams.where("status = 'LIVE'").agg(F.max("opens_at").alias("latest")))
plan("offset_pagination", lambda t: fi.page_of(t.uploads.select("id", "status", "created_at"), F.desc("created_at"), c("id"), limit=500, offset=100).select("id", "status", "total"))
plan("sweep_cap", lambda t: st.expired_attempts(t.attempts, t.exams, NOW, most=100).select("id", "status"))
plan("topk_figure_pages", lambda t: re.top(page_words(t).groupBy("job_id", "page").agg(F.count_if(c("text") == "diagram").alias("figures")), 5, F.desc("figures"), c("job_id"), c("page")))
plan("random_draw", lambda t: sq.draw(t.questions.where("is_active"), [(c("subject") == "ECONOMY", 5), (c("difficulty") == "HARD", 7), (lit(True), 3)], 11).select("rule", "place", "id"))
plan("seeded_order", lambda t: sq.seeded_order(t.exam_questions.where("exam_id < 5"), "exam_id", c("exam_id"), "question_id").select("exam_id", "question_id", "place"))
plan("seeded_shuffle", lambda t: sq.seeded_shuffle(t.exams.select("id", F.sequence(lit(1), lit(6)).alias("items"), (c("id") * 7919).alias("seed")), "items", "seed").select("id", F.array_join("shuffled", ",").alias("shuffled")))
plan("unseeded_shuffle", lambda t: sq.unseeded_shuffle(t.exams.select("id", F.sequence(lit(1), lit(6)).alias("items")), "items").select("id", F.array_join(F.array_sort("shuffled"), ",").alias("sorted")))
plan("assignment_expand", lambda t: re.expand_assignments(t.assignments, t.memberships))
plan("attempt_fanout", lambda t: re.expand_assignments(t.assignments, t.memberships).join(t.attempts.select("exam_id", "student_id"), ["exam_id", "student_id"], "left_anti"))
plan("notify_fanout", lambda t: t.students.where("branch_id = 2").select(c("id").alias("student_id"), F.explode(F.array(lit("IN_APP"), lit("EMAIL"))).alias("channel")))
plan("tagged_lists", lambda t: sq.tagged(t.papers.select("id", "title"), t.exams.where("kind = 'PAPER'").select("id", "title"), ("paper", "exam")))
plan("subject_union", lambda t: au.subject_names(t.paper_questions, t.questions, t.papers.select(c("id").alias("paper_id"), F.when(c("id") % 2 == 0, "Extra").alias("subject"))))
plan("duplicate_agreement", lambda t: sq.repeats_by_agreement(t.answers.where("is_correct IS NOT NULL"), ["attempt_id", "question_id"], "is_correct"))

# --- scalar functions
plan("fn_strings", lambda t: t.questions.select("id", F.upper(F.trim("name")).alias("up"), F.concat_ws("-", F.reverse(F.split("name", " "))).alias("swapped"), F.substring("name", 1, 3).alias("head"), F.lpad((c("id") % 100).cast("string"), 3, "0").alias("padded"), F.replace("name", lit("ring"), lit("RING")).alias("replaced"), F.startswith("name", lit("red")).alias("is_red")))
plan("fn_html", lambda t: t.questions.select("id", doc.escaped(F.concat(lit("<b>"), c("name"), lit(" & co</b>"))).alias("escaped"), doc.with_breaks(F.concat(c("name"), lit("\n<"))).alias("broken")))
plan("fn_templates", lambda t: t.exams.select("id", doc.exam_mail(lit("Ann"), c("title"), c("duration_seconds"), F.when(c("id") % 2 == 0, F.date_format("opens_at", "yyyy-MM-dd")), lit(None)).alias("body")))
plan("fn_regex", lambda t: t.drafts.select("id", ak.draft_number(c("text")).alias("number"), F.regexp_count("text", lit("[aeiou]")).alias("vowels")))
plan("fn_dates", lambda t: t.notifications.select("id", F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day"), (c("created_at") + F.expr("INTERVAL 7 DAYS")).alias("week_on"), F.floor(F.unix_seconds(c("created_at").cast("timestamp")) / 30).alias("bucket")))
plan("fn_math", lambda t: t.raw("part").select(c("p_partkey").alias("id"), an.rounded(c("p_retailprice") / 7, 3).alias("third"), F.least(lit(40), F.greatest(lit(5), "p_size")).alias("clamped"), F.abs(c("p_size") - 25).alias("away")))
plan("fn_decimals", lambda t: t.questions.select("id", (c("marks") - c("negative_marks")).cast("decimal(8,2)").alias("less"), (-c("negative_marks")).cast("decimal(8,2)").alias("negated"), (c("marks") < 3).alias("few")))
plan("fn_bits", lambda t: t.questions.select("id", c("id").bitwiseXOR(F.shiftleft("id", 3)).alias("mixed"), F.shiftright("id", 2).alias("right"), c("id").bitwiseAND(lit(7)).alias("low")))
plan("fn_arrays", lambda t: t.questions.select("id", F.split("name", " ").alias("w")).select("id", F.size("w").alias("n"), F.array_join(F.array_sort("w"), " ").alias("sorted"), F.exists("w", lambda w: w == "ring").alias("has_ring"), F.aggregate("w", lit(0), lambda a, w: a + F.length(w)).alias("letters")))
plan("fn_maps", lambda t: t.questions.select("id", F.map_from_arrays(F.array(lit("a"), lit("b")), F.array(c("size"), c("size") + 1)).alias("m")).select("id", F.size("m").alias("n"), F.element_at("m", "b").alias("b"), F.array_join(F.map_keys("m"), ",").alias("keys")))
plan("fn_json", lambda t: t.raw("events").select(c("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none")))
plan("fn_types", lambda t: t.raw("events").select(c("event_id").alias("id"), F.schema_of_variant(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")).isin("BIGINT", "DECIMAL(2,0)").alias("is_number"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string").isNotNull().alias("present")))


def first_words(t):
    """Different first words of documents, with accents and in either case."""
    word = F.regexp_extract("text", r"^([\p{L}]+)", 1)
    return t.raw("documents").select(word.alias("word")).where("word <> ''").distinct()


plan("fn_locale", lambda t: lo.sort_groups(first_words(t), "word").select("word", "letters", "folded", "same"))
plan("locale_equal", lambda t: lo.equal_words(first_words(t).select("word"), t.questions.select(F.explode(F.split("name", " ")).alias("name")).unionByName(first_words(t).select(F.lower("word").alias("name"))).distinct(), "word", "name").groupBy("word").agg(F.count("*").alias("n")))
plan("fn_hash", lambda t: t.questions.select("id", F.sha2("name", 256).alias("sha"), F.md5("topic").alias("md5")))

# --- grading
for _name, _type in (("grade_single", "SINGLE_CHOICE"), ("grade_visual", "VISUAL"), ("grade_true_false", "TRUE_FALSE"), ("grade_multiple", "MULTIPLE_CHOICE"), ("grade_fill_blank", "FILL_BLANK"), ("grade_match", "MATCH_FOLLOWING"), ("grade_matrix", "MATRIX_MATCH"), ("grade_descriptive", "DESCRIPTIVE")):
    plan(_name, lambda t, k=_type: grade(t.graded_input.where(c("type") == k)).select("attempt_id", "question_id", "line_no", "time_spent", "is_correct", "marks_awarded"))
plan("grade_blank", lambda t: grade(t.graded_input.where("line_no IN (6, 7) AND type <> 'DESCRIPTIVE'")).groupBy("type", "is_correct", "marks_awarded").agg(F.count("*").alias("n")))
plan("grade_dispatch", lambda t: grade(t.graded_input).groupBy("type", "is_correct").agg(F.count("*").alias("n"), F.sum("marks_awarded").cast("decimal(18,2)").alias("marks")))


# --- answer keys and page texts: texts are made from rows, so what should be found in them is known
def key_texts(t):
    """One key an attempt: 'number-answer' from its answers, in one of three spellings, with some invalid and zero entries."""
    a = t.answers.withColumn("number", c("question_id") % 12)
    letter = adapter.nth(list("ABCDZ"), c("time_spent") % 5)
    one = F.when(c("line_no") == 1, F.concat(lit("Q"), c("number").cast("string"), lit(". "), letter)).when(c("line_no") == 2, F.concat(c("number").cast("string"), lit(" ("), letter, lit(")"))).otherwise(F.concat(c("number").cast("string"), lit("-"), letter))
    return a.groupBy(c("attempt_id").alias("doc_id")).agg(F.concat_ws("\n", F.array_sort(F.collect_list(one))).alias("text"))


plan("key_pairs", lambda t: ak.key_pairs(key_texts(t)).groupBy("doc_id", "number", "answer").agg(F.count("*").alias("n")))
plan("key_count", lambda t: key_texts(t).select("doc_id", ak.pair_count(c("text")).alias("pairs")))
plan("key_parse", lambda t: ak.key_parse(key_texts(t), each_once=True))
plan("key_report", lambda t: ak.text_report(key_texts(t), each_once=True).select("doc_id", "entries", "starts_at_one", *[F.array_join(x, ",").alias(x) for x in ("missing", "duplicates", "conflicts", "invalid", "rejected")]))
plan("draft_number", lambda t: t.drafts.select("id", ak.draft_number(c("text")).alias("number")))


def key_drafts(t):
    return t.drafts.select(c("id").alias("draft_id"), c("id").alias("doc_id"), "text", (c("question_number") % 12).cast("int").alias("question_number"), "option_count", "options_length")


plan("key_assign", lambda t: ak.key_assign(key_drafts(t), ak.key_parse(key_texts(t), each_once=True)))


def page_texts(t):
    """Pages whose text is made up by their number: ten pages a file of every kind."""
    n, k = c("id") % 10 + 1, c("id") % 10
    lines = lambda one, m: F.array_join(F.transform(F.sequence(lit(1), lit(m)), one), "\n")
    filler = lambda m: F.repeat(lit("word "), m)
    text = (
        F.when(k == 0, lit("General Instructions\nTime allowed: 3 hours\nMaximum marks 180"))
        .when(k == 1, lit("a short note"))
        .when(k == 2, lines(lambda i: F.concat(i.cast("string"), lit(". What is it?\n(a) one\n(b) two")), 4))
        .when(k == 3, F.concat(lit("1. Only one question\n(a) x\n(b) y\n(c) z\n(d) w")))
        .when(k == 4, filler(90))
        .when(k == 5, filler(20))
        .when(k == 6, lit("OMR sheet: darken the circle"))
        .when(k == 7, F.concat(lit("Answer key\n"), lines(lambda i: F.concat(i.cast("string"), lit(" a")), 6)))
        .when(k == 8, lines(lambda i: F.concat(i.cast("string"), lit(" (b)")), 16))
        .otherwise(F.concat(lit("Solution: hence we get 4. "), filler(5)))
    )
    return t.uploads.select(F.floor(c("id") / 10).alias("doc_id"), n.cast("int").alias("page"), lit(10).alias("total_pages"), text.alias("text"))


plan("page_classify", lambda t: doc.classify_pages(page_texts(t)).select("doc_id", "page", "type", an.rounded(c("confidence"), 2).alias("confidence"), "words", "markers", "needs_review"))
plan("page_extractable", lambda t: doc.classify_pages(page_texts(t)).where(doc.extractable(c("type"), c("words"))).select("doc_id", "page"))
plan("page_tally", lambda t: doc.page_tally(doc.classify_pages(page_texts(t)), "doc_id"))


def key_page_texts(t):
    """Six pages a file: prose, a dense key, three pairs among words, a solution page, then keys again."""
    k = c("id") % 6
    grid = F.array_join(F.transform(F.sequence(lit(1), lit(8)), lambda i: F.concat(i.cast("string"), lit("-A"))), " ")
    text = F.when(k == 0, F.repeat(lit("word "), 30)).when(k == 1, grid).when(k == 2, F.concat(lit("1-A 2-B 3-C "), F.repeat(lit("word "), 40))).when(k == 3, lit("Solution: therefore we get 5. 1-A")).otherwise(grid)
    return t.uploads.select(F.floor(c("id") / 6).alias("doc_id"), (k + 1).cast("int").alias("page"), text.alias("text"))


plan("key_page_type", lambda t: doc.key_pages(key_page_texts(t)).select("doc_id", "page", "type", "pairs", "words", "solution_hits"))
plan("key_page_select", lambda t: doc.key_pages(key_page_texts(t)).where("used").select("doc_id", "page"))


def draft_texts(t):
    """A page with a question of two options, one with inline options, and an unanswered one with a solution."""
    i = c("id").cast("string")
    return t.uploads.select(c("id"), F.concat(lit("Q1. What is item "), i, lit("?\n(a) red\n(b) blue "), i, lit("\nmore\nQ2. Pick the right one of these (1) cat (2) dog (3) cow "), i, lit("\n3. Explain why item "), i, lit(" is so very heavy today\nSolution: it is lead\nand gold")).alias("text"))


plan("parse_drafts", lambda t: doc.parse_drafts(draft_texts(t), "id").select("id", "position", "text", "type", F.coalesce(F.array_join("options", "|"), lit("")).alias("options"), F.coalesce("solution", lit("")).alias("solution"), "needs_review"))
plan("split_inline_markers", lambda t: t.uploads.select("id", F.explode(doc.fused_lines(F.concat(lit("12. The first of the two questions that one line has come to hold "), c("id").cast("string"), lit(" 13. Second of them stands here")))).alias("part")))
plan("inline_options", lambda t: t.uploads.select("id", doc.inline_options(F.concat(lit("Pick one of item "), c("id").cast("string"), lit(" (1) cat (l) x (2) dog (3) cow"))).alias("o")).select("id", c("o.stem").alias("stem"), F.array_join("o.options", "|").alias("options")))
plan("strip_garbage", lambda t: t.uploads.select("id", doc.garbage_free(F.concat(lit("its value "), c("id").cast("string"), lit("kg 3c c @ 5 end of an A B"))).alias("g")).select("id", c("g.text").alias("text"), c("g.stripped").alias("stripped")))
plan("infer_type", lambda t: t.drafts.select("id", doc.question_type(F.concat("text", F.when(c("id") % 4 == 0, " Select all").when(c("id") % 4 == 1, " ____").when(c("id") % 4 == 2, " True or false").otherwise("")), c("option_count")).alias("type")))
plan("draft_html", lambda t: t.drafts.select("id", doc.paragraphs(F.concat(c("text"), lit("\n\n <i> & more "))).alias("html")))
plan("noise_stem", lambda t: t.drafts.select("id", doc.corrupted(F.concat("text", F.when(c("id") % 3 == 0, " @ x").otherwise(""))).alias("corrupted")))


# --- words on pages
def page_words(t):
    """Words of pages from order lines: sixty or so a page, most pages in two columns."""
    # a page is a part of a line's key, so lines that come twice meet where their page does
    lines = t.raw("lineitem").select(c("l_suppkey").alias("job_id"), (c("l_orderkey") % 10).alias("page"), "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    once = dealt(lines, ge.PAGE).groupBy(*ge.PAGE, "l_orderkey", "l_partkey", "l_linenumber").agg(F.max(F.struct("l_quantity", "l_extendedprice")).alias("m")).select("*", "m.*")
    k, x = c("l_linenumber"), c("l_extendedprice").cast("long") % 260
    x0 = (x + F.when((c("job_id") % 3 != 0) & (k % 2 == 0), 300).otherwise(0)).cast("double")
    x0 = F.when(k == 1, F.when(c("job_id") % 3 != 0, (c("l_partkey") % 2) * 300).otherwise(0)).otherwise(x0).cast("double")
    y0 = c("l_quantity") * 16
    text = (
        F.when(k == 1, F.concat((c("l_orderkey") % 60 + 1).cast("string"), lit("."))).when(k == 2, F.concat(lit("("), (c("l_partkey") % 4 + 1).cast("string"), lit(")"))).when(k == 3, F.concat(adapter.nth(list("ABCD"), c("l_partkey") % 4), lit(".")))
        .when(k == 4, F.when(c("l_partkey") % 2 == 0, "True").otherwise("false")).when(k == 5, F.concat(lit("word"), (c("l_partkey") % 50).cast("string"))).when(k == 6, lit("diagram")).otherwise(lit("@"))
    )
    return once.select(
        *ge.PAGE, (c("l_orderkey") * 1_000_000 + c("l_partkey") * 10 + k).alias("word_id"), text.alias("text"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 20 + c("l_partkey") % 20).alias("x1"), (y0 + 12).alias("y1"), ((c("l_quantity") % 10) / 10).alias("conf"),
    )


W, H = 600.0, 820.0
plan("watermark_tokens", lambda t: ge.watermarks(page_words(t)))
plan("column_split", lambda t: ge.column_splits(page_words(t)).select("job_id", "page", an.rounded(c("split_x"), 4).alias("split_x"), an.rounded(c("confidence"), 6).alias("confidence")))
plan("word_lines", lambda t: ge.lines(page_words(t)).groupBy("job_id", "page", "line").agg(F.count("*").alias("n")))
plan("reading_order", lambda t: ge.reading_order(page_words(t)).select("job_id", "page", "layout", F.size("columns").alias("columns"), F.length(F.array_join("columns", "\n")).alias("chars"), an.rounded(c("confidence"), 6).alias("confidence")))
plan("line_start", lambda t: ge.line_starts(page_words(t)).select("job_id", "page", "word_id"))
plan("question_punct", lambda t: ge.question_puncts(ge.line_markers(page_words(t))))
plan("markers", lambda t: ge.question_markers(page_words(t)).select("job_id", "page", "word_id", "num"))
plan("detect_columns", lambda t: ge.in_columns(ge.question_markers(page_words(t)), W).select("job_id", "page", "word_id", "col", "left", "right"))
plan("sequence_validate", lambda t: ge.valid_sequence(ge.in_columns(ge.question_markers(page_words(t)), W)).select("job_id", "page", "word_id", "num"))


def boxes(t):
    return written(ge.regions(marks_of(t), W, H))


def found_marks(t):
    """Question markers of pages, written, and those that are in sequence."""
    found = written(ge.question_markers(page_words(t)))
    return found, written(ge.valid_sequence(ge.in_columns(found, W)))


def marks_of(t):
    return found_marks(t)[1]


plan("build_regions", lambda t: boxes(t).select("job_id", "page", "col", "place", "x0", "y0", "x1", "y1"))
plan("words_in_region", lambda t: ge.words_in(page_words(t), boxes(t), "col", "place").groupBy("job_id", "page", "col", "place").agg(F.count("*").alias("n")))


# --- pages of one column, a numbered question every forty units, from questions: forty a page


def numbered_pages(t, text, *more):
    """The number word of each question (``text`` of num and idx) and further words (text, x, down, condition) beside and below it."""
    idx = c("id") % 40
    q = t.questions.select(c("id").alias("of"), F.floor(c("id") / 40).cast("long").alias("job_id"), idx.cast("int").alias("idx"), (101 + idx).cast("int").alias("num"))
    words = [F.struct(text.alias("text"), lit(10.0).alias("x0"), lit(0.0).alias("dy"), lit(0).alias("k"))]
    words += [F.when(when, F.struct(lit(w).alias("text"), lit(float(x)).alias("x0"), lit(float(dy)).alias("dy"), lit(k).alias("k"))) for k, (w, x, dy, when) in enumerate(more, 1)]
    w = q.select("*", F.explode(F.array_compact(F.array(*words))).alias("w")).where("w.text IS NOT NULL")
    y0 = c("idx") * 40.0 + c("w.dy")
    return w.select("job_id", lit(1).alias("page"), (c("of") * 10 + c("w.k")).alias("word_id"), "w.text", "w.x0", y0.alias("y0"), (c("w.x0") + 24.0).alias("x1"), (y0 + 12.0).alias("y1"), lit(0.9).alias("conf"), "idx")


def misread(t):
    """Even pages have numbers cut to their last digit, odd ones numbers with a wrong first digit."""
    even, n = c("job_id") % 2 == 0, c("num")
    text = F.when(even & (c("idx") % 10 == 3), n % 10).when(~even & (c("idx") % 10 == 7), n + 100).otherwise(n)
    return ge.in_columns(written(ge.question_markers(numbered_pages(t, F.concat(text.cast("string"), lit("."))), None)), W)


def whole_pages(words):
    box = {"col": 0, "h": 12.0, "q_punct": ".", "place": 0, "x0": 5.0, "y0": 0.0, "x1": 600.0, "y1": 2000.0}
    return words.select("job_id", "page").distinct().select("job_id", "page", *[lit(v).alias(k) for k, v in box.items()])


def gappy(t):
    """Only a page's first number has its mark; one in seven is missing."""
    n = c("num").cast("string")
    return numbered_pages(t, F.when((c("idx") == 0) | (c("of") == 1), F.concat(n, lit("."))).when(c("idx") % 7 != 3, n))


def unfinished(t):
    """Questions of a page, each with a stem; only every third has options."""
    last = c("idx") % 3 == 2
    words = numbered_pages(t, F.concat(c("num").cast("string"), lit(".")), ("stem", 60, 0, lit(True)), ("words", 120, 0, lit(True)), ("(a)", 30, 15, last), ("(b)", 80, 15, last))
    rows = words.select("job_id", "page", "idx").distinct()
    return words, rows.select("job_id", "page", lit(0).alias("col"), lit(12.0).alias("h"), lit(".").alias("q_punct"), c("idx").alias("place"), lit(0.0).alias("x0"), (c("idx") * 40.0 - 5).alias("y0"), lit(600.0).alias("x1"), (c("idx") * 40.0 + 35).alias("y1"))


plan("recover_truncated", lambda t: ge.truncated_numbers(misread(t)))
plan("recover_century", lambda t: ge.century_numbers(misread(t).where("job_id % 2 = 1")))  # cut numbers are set right before
plan("split_internal", lambda t: ge.split_regions(whole_pages(w := numbered_pages(t, F.concat(c("num").cast("string"), lit(".")))), w).select("job_id", "page", "place", "y0", "y1"))
plan("recover_gaps", lambda t: ge.gap_splits(whole_pages(w := gappy(t)), w).select("job_id", "page", "place", "y0", "y1"))
plan("merge_incomplete", lambda t: ge.merged_regions(*reversed(unfinished(t))).select("job_id", "page", "place", "y0", "y1", F.size("ws").alias("words")))


def page_blocks(t):
    """The words of each page as one block, and a family of question numbers by the job."""
    g = page_words(t).groupBy("job_id", "page").agg(F.array_sort(F.collect_list(F.struct(c("y0").cast("double").alias("y0"), "word_id", "text", c("x0").alias("x0")))).alias("ws"))
    return g.withColumn("q", F.when(c("job_id") % 2 == 0, ")").otherwise("."))


plan("block_class", lambda t: page_blocks(t).select("job_id", "page", ge.block_class(c("ws"), c("q")).alias("kind")))
plan("has_stem", lambda t: page_blocks(t).select("job_id", "page", ge.has_stem(c("ws"), c("q")).alias("stem")))
plan("complete_block", lambda t: page_blocks(t).select("job_id", "page", ge.complete(c("ws"), c("q")).alias("complete")))
plan("option_markers", lambda t: page_blocks(t).select("job_id", "page", F.size(ge.option_labels(c("ws"), c("q"))).alias("labels"), ge.option_count(c("ws")).alias("options")))
plan("region_confidence", lambda t: page_words(t).select("job_id", "page", "word_id", an.rounded(ge.region_confidence(c("y0"), c("y1") + 8, (c("word_id") % 9), (c("word_id") % 4), c("word_id") % 2 == 0, H), 2).alias("confidence")))
plan("draft_assemble", lambda t: dr.drafts_of_pages(page_words(t), W, H, texts=False).select("job_id", "page", "col", "position", "question_number", "kind", "options", an.rounded(c("confidence"), 2).alias("confidence"), "invalid_crop", "needs_review", "span_page_end"))


def stitched(t, marks=None):
    """Drafts of the plain regions of pages, stitched over the pages of a job."""
    marks = marks_of(t) if marks is None else marks
    return written(dr.drafts_of_regions(page_words(t), written(ge.regions(marks, W, H)), marks, W, H))


def traced(t):
    found, marks = found_marks(t)
    return dr.missing_trace(stitched(t, marks), dr.numbers_read(page_words(t)), found, marks, 62)


plan("draft_stitch", lambda t: stitched(t).select("job_id", "page", "col", "position", "question_number", "kind", "options", an.rounded(c("confidence"), 2).alias("confidence"), "invalid_crop", "needs_review", "words", "span_page_end", "header_x0", "header_x1", "header_y1"))
plan("missing_trace", traced)
plan("crowded_crops", lambda t: dr.crowded_crops(stitched(t)).select("job_id", "position", F.array_join("numbers", ",").alias("numbers")))
plan("review_counts", lambda t: dr.review_counts(stitched(t)).select("job_id", F.array_join("numberless", ",").alias("numberless"), "needs_review"))
plan("quality_report", lambda t: ge.quality_report(t.drafts.select("job_id", "question_number", (c("id") % 11 == 0).alias("invalid_crop"))).select("job_id", "detected", "invalid", "lo", "hi", F.array_join("missing", ",").alias("missing"), F.array_join("duplicates", ",").alias("duplicates"), "coverage_pct"))


def figures(t):
    return page_words(t).where("text = 'diagram'").withColumn("figure_id", c("word_id"))


def page_drafts(t):
    return page_words(t).where("text LIKE '%.' AND y0 < 400").select("job_id", "page", c("word_id").alias("place"))


def text_regions(t):
    return page_words(t).where("text LIKE 'word%'").select("job_id", "page", c("word_id").alias("reading_order"), "y0", "y1")


plan("figure_attach_region", lambda t: ge.attach_by_region(figures(t), page_drafts(t), text_regions(t)))
plan("figure_attach_stripe", lambda t: ge.attach_by_stripe(figures(t), page_drafts(t), H))
plan("garbage_clusters", lambda t: ge.garbage_clusters(page_words(t), least_conf=0.15, px=20))
plan("region_quality", lambda t: ge.region_quality(page_words(t), "job_id", "page").select("job_id", "page", an.rounded(c("quality"), 4).alias("quality")))
plan("noise_token", lambda t: page_words(t).select("job_id", "page", "word_id", ge.noise_token(c("text")).alias("noise")))
plan("bbox_distance", lambda t: page_words(t).where("conf = 0.1").select("job_id", "page", "word_id", *[c(x).alias(f"a_{x}") for x in ("x0", "y0", "x1", "y1")], lit(100.0).alias("b_x0"), lit(200.0).alias("b_y0"), lit(150.0).alias("b_x1"), lit(260.0).alias("b_y1")).select("job_id", "page", "word_id", ge.box_distance("a_", "b_").alias("away")))
plan("words_inside", lambda t: ge.words_in(page_words(t), page_words(t).select("job_id", "page").distinct().select("job_id", "page", lit(0.0).alias("x0"), lit(0.0).alias("y0"), lit(200.0).alias("x1"), lit(400.0).alias("y1")), closed=True).select("job_id", "page", "word_id"))


def layout_regions(t):
    kind = F.when(c("text") == "diagram", "FIGURE").when(c("text").like("word%"), "TEXT").otherwise("TABLE")
    return page_words(t).withColumns({"type": kind, "region_id": c("word_id")})


plan("bbox_extend", lambda t: ge.extended_boxes(layout_regions(t), c("text") == "diagram", 40.0, W, H))

# --- state machines, replayed over whole tables
plan("s_auto_submit", lambda t: st.expired_attempts(t.attempts, t.exams, "1998-01-01").select("id", "status", "auto_submitted"))
plan("s_exam_transition", lambda t: st.exam_transitions(t.exams, "2001-06-01"))
plan("s_violation_state", lambda t: st.violation_states(t.violations))
plan("s_answer_upsert", lambda t: st.upserted_answers(t.answers.withColumn("time_spent", F.when(c("line_no") != 3, c("time_spent")))))
plan("s_heartbeat", lambda t: st.heartbeats(t.attempts.withColumn("started_at", ts(NOW) - adapter.seconds(c("id") % 8000)), t.exams, F.when(c("id") % 3 == 0, c("id") % 1000), NOW))
plan("s_analytics_job", lambda t: an.question_stats(t.answers.join(st.touched(t.answers, t.attempts, t.attempts.where("status = 'GRADED' AND exam_id = 6").select("id"))[0], "question_id", "left_semi")).select("question_id", "total", "correct"))
plan("s_outbox_dispatch", lambda t: st.outbox(t.notifications, c("id") % 4 != 0))
plan("s_tick_dedupe", lambda t: st.ticks(t.violations, "server_ts"))
plan("s_stuck_uploads", lambda t: st.stuck_uploads(t.uploads, "2024-01-01 08:00:00"))
plan("s_callback_idempotent", lambda t: st.new_callbacks(t.uploads.select((c("id") % 300).alias("job_id")), t.drafts.groupBy("job_id").agg(F.bool_and(c("status") == "APPROVED").alias("finished"), F.count_if(c("status") == "APPROVED").alias("drafts"))))
plan("s_progress_merge", lambda t: st.merged_progress(t.violations.select(c("attempt_id").alias("job_id"), "server_ts", "id", F.when(c("id") % 2 == 0, c("type")).alias("stage"), F.when(c("id") % 3 == 0, c("id") % 50).alias("processed")), "job_id", "server_ts", "id"))
plan("s_rate_limit", lambda t: st.rate_limited(t.violations, "type", "server_ts", most=2, width=3600))

# --- routing and calibration
plan("word_stats", lambda t: ro.word_stats(page_words(t).select("job_id", "page", (c("conf") * 100).alias("conf")), "job_id", "page"))


def files(t):
    """Files with texts from drafts and figures from their ids."""
    i = c("id")
    text = F.when(i % 7 == 0, "x").when(i % 7 == 1, F.concat(c("text"), lit(" §§§ ¶¶ ~~ §§§"))).when(i % 7 == 2, F.repeat(lit("xzrt bcdf aaab "), 9)).otherwise(F.repeat(F.concat(c("text"), lit(" ")), 6))
    return t.drafts.select(
        "id", text.alias("text"), lit(1).alias("pages"), (i % 50 == 0).alias("sentinel"), F.concat(F.when(i % 9 == 0, "/Answers/").otherwise("/papers/"), i.cast("string")).alias("storage_key"), F.when(i % 4 == 3, "image/png").otherwise("application/pdf").alias("mime"),
        F.when(i % 5 != 0, (i % 8) * 30.0).alias("layer_chars"), (i % 12).cast("int").alias("words"), (i % 10 * 10).cast("double").alias("median"), ((i % 6) / 6.0).alias("low_ratio"), ((i % 11) / 10.0).alias("confidence"),
    )


def decided(t):
    return ro.decide(ro.signals(ro.pre_route(files(t))))


plan("alpha_noise", lambda t: files(t).select("id", an.rounded(ro.noise_ratio(c("text")), 6).alias("noise")))
plan("nondict_ratio", lambda t: files(t).select("id", an.rounded(ro.nondict_ratio(c("text")), 6).alias("nondict")))
plan("pre_route", lambda t: ro.pre_route(files(t)).select("id", "hint", "verdict"))
plan("route_signal", lambda t: ro.signals(ro.pre_route(files(t))).select("id", "chars_per_page", "near_empty"))
plan("route_decide", lambda t: decided(t).select("id", "route", "score", "reason"))
plan("route_predict", lambda t: decided(t).select("id", ro.predicted(lit(0.35)).alias("routed")))
plan("routing_summary", lambda t: ro.summary(decided(t)))
plan("routing_counters", lambda t: ro.counters(decided(t)))
plan("log_source", lambda t: ro.read_log(t.drafts.select(F.when(c("id") % 3 == 0, F.concat(lit("12:00 [ocr-routing] "), F.to_json(F.struct(c("text").alias("storageKey"), (c("id") % 2 == 0).alias("wouldRoute"), lit("near_empty").alias("reason"))))).when(c("id") % 3 == 1, lit("[ocr-routing] {broken")).otherwise(lit("other")).alias("line"))).groupBy("wouldRoute", "reason").agg(F.count("*").alias("n"), F.count_distinct("storageKey").alias("files")))


def swept(t):
    return ro.sweep(decided(t).withColumn("key", c("id")), t.drafts.where("id % 3 <> 0").select(c("id").alias("key"), (c("id") % 4 < 2).alias("handwritten")))


plan("threshold_sweep", swept)
plan("threshold_pick", lambda t: ro.pick(swept(t)).select("threshold", "f1"))
plan("threshold_pick_precise", lambda t: ro.pick(swept(t), 0.3).select("threshold", "precision", "recall"))

# --- authoring


def payloads(t):
    """Questions with payloads that break their rules in some rows."""
    i, k = c("id"), c("type")
    payload = (
        F.when(i % 11 == 0, "{broken").when(k == "TRUE_FALSE", F.when(i % 3 == 0, '{"correct": "yes"}').otherwise('{"correct": true}')).when(k == "FILL_BLANK", F.when(i % 3 == 0, '{"accepted": [], "caseSensitive": true}').when(i % 3 == 1, '{"accepted": ["x"]}').otherwise('{"accepted": ["x"], "caseSensitive": false}'))
        .when(k == "MATCH_FOLLOWING", F.when(i % 3 == 0, '{"pairs": [{"left": "a", "right": "b"}]}').otherwise('{"pairs": [{"left": "a", "right": "b"}, {"left": "c", "right": "d"}]}')).when(k == "MATRIX_MATCH", F.when(i % 3 == 0, '{"rows": ["r"], "cols": []}').when(i % 3 == 1, '{"rows": ["r"], "cols": ["c"]}').otherwise('{"rows": ["r"], "cols": ["c"], "correctMap": {"r": ["c"]}}'))
        .when(k == "DESCRIPTIVE", F.when(i % 3 == 0, '{"maxWords": 0}').otherwise("{}")).when(k == "VISUAL", F.when(i % 3 == 0, '{"optionCount": 4}').when(i % 3 == 1, '{"contentHtml": "<img>", "optionCount": 9}').otherwise('{"contentHtml": "<img>", "optionCount": 4}')).otherwise("{}")
    )
    return t.questions.select("id", "type", payload.alias("payload"), (c("size") % 5).alias("options"), (c("size") % 3).alias("right"))


plan("validate_question", lambda t: au.question_errors(payloads(t)).select("id", "error"))


def taxonomy(t):
    p = t.raw("region").select(c("r_regionkey").alias("id"))
    s = t.branches.select("id", c("tenant_id").alias("program_id"), "name")
    ch = t.classrooms.select("id", c("branch_id").alias("subject_id"), "name")
    return p, s, ch, t.students.select("id", (c("id") % 50).alias("chapter_id"))


plan("taxonomy_chain", lambda t: au.taxonomy_errors(t.drafts.select("id", (c("id") % 6).alias("program_id"), F.when(c("id") % 5 != 0, c("id") % 27).alias("subject_id"), F.when(c("id") % 7 != 0, c("id") % 12).alias("chapter_id"), F.when(c("id") % 3 != 0, c("id") % 160).alias("topic_id")), *taxonomy(t)).select("id", "error"))
plan("publish_gate", lambda t: au.publish_gate(t.exams, t.exam_questions.where("exam_id <> 4"), t.assignments.where("exam_id <> 16"), re.expand_assignments(t.assignments, t.memberships).where("exam_id % 5 <> 0"), "TEACHER", 1, "1996-06-01"))
plan("shift_numbers", lambda t: au.insert_draft(t.drafts, 3, 40, -1).select("id", "question_number", "position"))
plan("move_number", lambda t: au.move_draft(t.drafts, 3, 603, 25).select("id", "question_number", "position"))
plan("clone_exam", lambda t: au.cloned(t.exams.select("id", "title", "status", "total_marks"), t.exam_questions, "exam_id", c("id") == 8, 1000)[1].select("exam_id", "question_id", "position"))
plan("clone_paper", lambda t: au.cloned(t.papers, t.paper_questions, "paper_id", c("id") < 3, 1000)[0].select("id", "title", "status", "source_id"))
plan("exam_from_paper", lambda t: au.exam_from_paper(t.papers, t.paper_questions, 4, 900, 0.25)[1])
plan("denorm_names", lambda t: au.named(t.drafts.select("id", (c("id") % 30).alias("subject_id"), (c("id") % 14).alias("chapter_id"), c("assigned_subject").alias("subject_text")), t.branches.select("id", "name"), t.classrooms.select("id", "name")).select("id", "subject", "chapter"))
plan("batch_order", lambda t: au.batch_order(t.uploads.where("id % 20 IN (0, 5, 11)").unionByName(t.uploads.where("id = 25")).select(F.coalesce("batch_id", lit(-1)).alias("batch_id"), "id", "status", "created_at")))
plan("draft_state", lambda t: t.drafts.select("id", "status", F.explode(F.array(lit("edit"), lit("discard"), lit("revert"))).alias("action")).select("id", "action", au.draft_after(c("status"), c("action")).alias("after")))
plan("upload_state", lambda t: t.uploads.select("id", au.upload_after(c("status"), F.concat(F.when(c("id") % 3 == 0, "/question-images/").otherwise("/papers/"), c("storage_key"))).alias("after")))
plan("classroom_unique", lambda t: au.classroom_conflicts(t.classrooms.withColumn("branch_id", c("branch_id") % 2).withColumn("name", F.concat(lit(" "), F.lower("name")))))
plan("user_list", lambda t: fi.page_of(t.students.where("class_label = 'BUILDING' AND branch_id = 2").select("id", "name"), c("name"), c("id"), limit=50))
plan("branch_list", lambda t: t.branches.where("deleted_at IS NULL").select("id", "name"))
plan("soft_delete", lambda t: au.soft_deleted(t.branches, c("id") < 8, "2025-05-05").select("id", "deleted_at"))
plan("bulk_patch", lambda t: au.patched(t.drafts.select("id", "status", "assigned_subject"), t.drafts.where("id % 10 = 0").select("id", F.when(c("id") % 20 == 0, "EDITED").alias("status"), F.when(c("id") % 30 == 0, "S9").alias("assigned_subject"))))
plan("bulk_result", lambda t: au.approvals(t.drafts))
plan("json_ingest", lambda t: t.raw("events").select(c("event_id").alias("id"), F.from_json("props", "k int").alias("p")).select("id", c("p.k").alias("k")).where("k IS NOT NULL").join(t.drafts.where("status = 'APPROVED'").select("id"), "id", "left_anti"))
SECRET = b"a shared secret"


def callback_calls(t):
    """Signed bodies, a call a document, in words of its text; some are unsigned, forged, broken, of unknown jobs or say that reading failed."""
    i, word = c("doc_id"), F.regexp_extract("text", r"^([\p{L}]*)", 1)
    draft = F.concat(lit('{"position":0,"text":"'), word, lit('","optionCount":4,"options":[{"label":"'), word, lit('"},{"label":"x","isCorrect":true}],"figures":[{"storageKey":"f/'), i.cast("string"), lit('","kind":"DIAGRAM","boundingBox":{"x0":1,"y0":2,"x1":3,"y1":4}}]},{"position":1,"text":"next"}'))
    body = F.concat(lit('{"ocrJobId":'), (i % 400).cast("string"), lit(',"overallConfidence":0.5,"drafts":['), draft, lit("]"), F.when(i % 13 == 0, ',"errorMessage":"unreadable"').otherwise(""), F.when(i % 17 == 0, "").otherwise("}"))
    sign = cb.hmac_sha256(SECRET, body)
    return t.raw("documents").select(i.alias("call_id"), body.alias("body"), F.when(i % 11 == 0, None).when(i % 7 == 0, F.reverse(sign)).otherwise(sign).alias("signature"))


def callback_results(t):
    jobs = t.uploads.where("id < 300").select(c("id").alias("job_id"), (c("status") == "READY").alias("finished"), F.when(c("id") % 9 == 0, 2).otherwise(0).alias("drafts"))
    return cb.checked(callback_calls(t), jobs, SECRET)


plan("callback_outcomes", lambda t: callback_results(t).select("call_id", "signature", "outcome"))
plan("callback_drafts", lambda t: cb.drafts_of_calls(callback_results(t)).select("job_id", "position", "text", "option_count", F.size("options").alias("options"), F.exists("options", lambda o: o["is_correct"]).alias("keyed"), "figures"))
plan("callback_figures", lambda t: cb.figures_of_calls(callback_results(t)).select("job_id", "position", "figure_index", "storage_key", "kind", "caption", c("box.y1").alias("y1")))
plan("callback_jobs", lambda t: cb.job_outcomes(callback_results(t)))
plan("rows_sink", lambda t: au.appended_rows(t.attempts.select("exam_id", "student_id"), re.expand_assignments(t.assignments, t.memberships).select(c("exam_id").cast("long"), "student_id"), "exam_id", "student_id").groupBy("exam_id").agg(F.count("*").alias("n")))
plan("upsert_sink", lambda t: au.upserted_rows(t.questions.select("id", "topic", "difficulty"), t.questions.where("id % 4 = 0").select("id", lit("NEW").alias("topic"), "difficulty"), "id").groupBy("topic").agg(F.count("*").alias("n")))
