"""The rows that registered queries should give, in DuckDB's SQL, from the rules and not from the plans."""

from gradeloom.plans.registry import expect

TR = "(SELECT *, correct * 100.0::DOUBLE / total AS p, correct * 100.0::DOUBLE / total < 60 AS weak FROM topic_counts)"
DONE = "status IN ('SUBMITTED', 'GRADED', 'FLAGGED')"
GRADED = "status IN ('GRADED', 'FLAGGED')"
#: An attempt's percentage in whole billionths.
PCT = "CAST(floor(coalesce(score, 0)::DOUBLE * 100 / greatest(1, total_marks::DOUBLE) * 1e9 + 0.5) AS DECIMAL(30,0))"


def r(x, places=1):
    k = 10**places
    return f"(floor(({x}) * {k}.0::DOUBLE + 0.5) / {k}.0::DOUBLE)"


MEAN = f"coalesce({r(f'sum({PCT}) FILTER ({GRADED})::DOUBLE / nullif(count(*) FILTER ({GRADED}), 0) / 1e9')}, 0)"
FLAG = "CASE WHEN coalesce(total, 0) = 0 THEN 'normal' WHEN correct / total >= 0.95 THEN 'too_easy' WHEN correct / total <= 0.2 THEN 'too_hard' WHEN total >= 10 AND abs(correct / total - 0.5) < 0.1 THEN 'ambiguous' ELSE 'normal' END"
ASSIGNED = "(SELECT DISTINCT a.exam_id, coalesce(a.student_id, m.student_id) AS student_id FROM assignments a LEFT JOIN memberships m ON m.classroom_id = a.classroom_id WHERE coalesce(a.student_id, m.student_id) IS NOT NULL)"
EXPIRED = "SELECT a.* FROM attempts a JOIN exams e ON e.id = a.exam_id WHERE a.status = 'IN_PROGRESS' AND a.started_at + to_seconds(e.duration_seconds) < TIMESTAMP '{}'"
QS = "(SELECT question_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, sum(time_spent)::DOUBLE / count(*) AS avg_time FROM answers WHERE is_correct IS NOT NULL GROUP BY 1)"

# --- scans, filters, projections
expect("scan_predicate", "SELECT id, student_id FROM attempts WHERE status = 'SUBMITTED' AND exam_id = 4")
expect("point_lookup", "SELECT id, title, duration_seconds FROM exams WHERE id = 17")
expect("paged_scan", "SELECT id, name, (SELECT count(*) FROM students WHERE class_label = 'BUILDING') AS total FROM students WHERE class_label = 'BUILDING' ORDER BY name, id LIMIT 50 OFFSET 20")
expect("f_tenant_scope", "SELECT s.id, s.branch_id FROM students s JOIN branches b ON b.id = s.branch_id WHERE tenant_id = 1")
expect("f_role_scope", "SELECT id, title FROM exams WHERE created_by = 3 AND branch_id = 10")
expect("f_in_list", "SELECT id, status FROM attempts WHERE (status = 'SUBMITTED' OR status = 'GRADED') AND exam_id BETWEEN 1 AND 3")
expect("f_not_in", "SELECT id FROM questions WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 50 = 7)")
expect("f_null_checks", "SELECT event_id AS id, user_id FROM events WHERE value > 10 AND NOT value > 20 AND event_type NOT IN ('click', 'error')")
expect("f_range", "SELECT o_orderkey AS id, o_orderkey % 50 AS exam_id FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_totalprice > 1000")
expect("f_ilike", "SELECT id, name FROM questions WHERE name ILIKE '%brass%' OR subject ILIKE '%brass%' OR name ILIKE '%red%'")
expect("f_ci_equals", "SELECT id, name FROM classrooms WHERE name ILIKE 'class 3' OR subject IS NULL")
expect("f_nested_bool", "SELECT id FROM students WHERE branch_id NOT BETWEEN 5 AND 20 AND (class_label = 'BUILDING' OR roll_no IS NULL)")
expect("f_not_or", "SELECT id, status FROM uploads WHERE batch_id IS NULL AND status <> 'READY' AND branch_id <> 4 AND storage_key NOT LIKE 'web/%'")
expect("f_exists_none", "SELECT id, id IN (SELECT o_custkey FROM orders) AS has_attempts FROM students")
expect("f_col_arith", f"SELECT id FROM ({EXPIRED.format('1997-01-01')})")
expect("p_denorm", "SELECT a.id, a.status, e.title, e.total_marks, s.name AS student, s.class_label FROM attempts a JOIN exams e ON e.id = a.exam_id JOIN students s ON s.id = a.student_id WHERE e.id = 5")
expect("p_coalesce_default", "SELECT a.id, ifnull(a.score, 0)::DECIMAL(12,2) AS score, ifnull((SELECT c_name FROM customer WHERE c_custkey = a.student_id AND c_nationkey < 20), '(missing)') AS name FROM attempts a")
expect("p_case_state", "SELECT doc_id AS id, ['QUEUED','QUEUED','PROCESSING','COMPLETED','FAILED'][doc_id % 5 + 1] AS state FROM documents")
expect("p_sanitize", """SELECT attempt_id, question_id, line_no, time_spent, type, CASE type WHEN 'FILL_BLANK' THEN '{"contentHtml":"","caseSensitive":' || if(question_id % 3 = 0, 'true', 'false') || '}' WHEN 'MATCH_FOLLOWING' THEN '{"contentHtml":"","lefts":["A","B"],"rights":["1","2"]}'
  WHEN 'MATRIX_MATCH' THEN '{"contentHtml":"","rows":[],"cols":[]}' WHEN 'DESCRIPTIVE' THEN '{"contentHtml":"","rubric":null,"maxWords":null}' ELSE '{"contentHtml":""}' END AS payload FROM graded""")
expect("p_config_overlay", "SELECT event_id AS id, CAST(coalesce(json_extract_string(props, '$.k'), '50') AS INTEGER) AS k, 3 AS tab_switch FROM events")
expect("p_precedence3", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'E' || o_orderkey % 10 WHEN o_custkey % 3 = 0 THEN 'S' || o_custkey % 10 ELSE 'D' || (o_orderkey % 200) % 3 END AS subject FROM orders")
expect("p_recommend", f"SELECT student_id, subject, topic, 'Revise ' || topic || ' — currently ' || CAST(floor({r('p', 2)} + 0.5) AS BIGINT) || '% correct' AS for_staff, 'Focus on ' || topic || ' — current score ' || CAST(floor({r('p', 2)} + 0.5) AS BIGINT) || '%' AS for_student FROM {TR} WHERE weak")

# --- joins
expect("j_inner_expired", f"SELECT id, exam_id FROM ({EXPIRED.format('1997-01-01')})")
expect("j_answers_questions", "SELECT l_orderkey AS attempt_id, l_linenumber AS line_no, p_type AS subject, p_brand AS topic, CAST(l_quantity AS BIGINT) AS time_spent FROM lineitem, part, orders WHERE l_partkey = p_partkey AND l_orderkey = o_orderkey AND o_orderkey % 50 = 9")
expect("j_left_map_default", "SELECT o_orderkey AS id, if(o_orderkey % 50 % 5 = 0, '(missing)', 'Exam ' || o_orderkey % 50) AS title, CAST(if(o_orderkey % 50 % 5 = 0, 0, 1800 + 600 * (o_orderkey % 50 % 7)) AS BIGINT) AS duration_seconds FROM orders")
expect("j_left_meta", f"SELECT s.question_id, s.total, if(p_size % 10 <> 0, p_brand, '') AS topic FROM {QS} s JOIN part ON p_partkey = s.question_id")
expect("j_left_result", "SELECT attempt_id, question_id, line_no, time_spent, if(question_id IN (SELECT question_id FROM exam_questions WHERE exam_id = 3), question_id::VARCHAR, '') AS position FROM answers")
LAST = "(SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY attempt_id, question_id ORDER BY saved_at DESC, line_no DESC, time_spent DESC) = 1)"
expect("j_left_grade", f"""SELECT a.id AS attempt_id, count(*) AS asked, count(*) FILTER (m.is_correct) AS correct, CAST(sum(coalesce(m.marks_awarded, 0)) AS DECIMAL(18,2)) AS marks FROM attempts a JOIN exam_questions e ON e.exam_id = a.exam_id
  LEFT JOIN {LAST} m ON m.attempt_id = a.id AND m.question_id = e.question_id WHERE a.exam_id = 2 GROUP BY 1""")
expect("j_semi_some", "SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
expect("j_anti_none", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
expect("j_anti_present", "SELECT p_partkey AS id FROM part WHERE p_type = 'ECONOMY' AND p_partkey % 20 >= 15")
expect("j_semi_valid", "SELECT o_orderkey AS id, o_orderkey % 200 AS job_id FROM orders WHERE o_orderkey % 200 IN (SELECT doc_id FROM documents)")
expect("j_update_from", "SELECT e.id, CAST(if(e.id >= 10, e.branch_id, c_nationkey) AS BIGINT) AS branch_id FROM exams e LEFT JOIN customer ON c_custkey = e.created_by")
expect("j_self_dedupe", "SELECT student_id, arg_max(classroom_id, (joined_at, classroom_id)) AS classroom_id FROM memberships GROUP BY 1")
expect("j_cross_insert", "SELECT status, count(*) AS n FROM (SELECT exam_id, student_id, status FROM attempts WHERE student_id <> (SELECT min(c_custkey) FROM customer) OR exam_id NOT IN (SELECT id FROM exams) UNION ALL SELECT id, (SELECT min(c_custkey) FROM customer), 'NOT_STARTED' FROM exams) GROUP BY 1")
expect("j_aligned_zip", "SELECT (SELECT count(*) FROM exams) AS exams, (SELECT count(*) FROM customer) AS students, (SELECT count(*) FROM part WHERE p_size % 10 <> 0) AS questions")

# --- rollups and reports
expect("question_stats", f"SELECT question_id, total, correct, {r('avg_time', 2)} AS avg_time_seconds, {r('1 - correct / total', 3)} AS difficulty_score FROM {QS}")
expect("topic_reports", f"SELECT student_id, subject, topic, total, correct, {r('p', 2)} AS score_percent, weak AS is_weak FROM {TR}")
expect("subject_performance", f"SELECT student_id, subject, CAST(sum(total) AS BIGINT) AS attempts, CAST(sum(correct) AS BIGINT) AS correct, count(*) AS topics, count(*) FILTER (weak) AS weak_topics, sum(correct)::DOUBLE * 100 / sum(total) AS percent FROM {TR} GROUP BY ALL")
expect("exam_summary", f"SELECT e.id AS exam_id, count(a.id) AS total_attempts, count(*) FILTER (a.{DONE}) AS submitted, count(*) FILTER (a.{GRADED}) AS graded, coalesce((sum(coalesce(a.score, 0)) FILTER (a.{GRADED}))::DOUBLE / nullif(count(*) FILTER (a.{GRADED}), 0), 0) AS avg_score FROM exams e LEFT JOIN attempts a ON a.exam_id = e.id GROUP BY 1")
expect("exam_score_histogram", f"""SELECT e.id AS exam_id, CAST(b AS INTEGER) AS bucket, count(p) AS n FROM exams e CROSS JOIN range(5) t(b) LEFT JOIN
  (SELECT a.exam_id, coalesce(a.score, 0)::DOUBLE * 100 / if(x.total_marks = 0, 1, x.total_marks::DOUBLE) AS p FROM attempts a JOIN exams x ON x.id = a.exam_id WHERE a.{GRADED}) s ON s.exam_id = e.id AND least(4, greatest(0, floor(p / 20))) = b GROUP BY ALL""")
EQ = "(SELECT e.exam_id, e.question_id, e.position, count(w.is_correct) AS total, count(*) FILTER (w.is_correct) AS correct, coalesce((sum(w.time_spent) FILTER (w.is_correct IS NOT NULL))::DOUBLE / nullif(count(w.is_correct), 0), 0) AS avg_time FROM exam_questions e LEFT JOIN (SELECT w.*, t.exam_id FROM answers w JOIN attempts t ON t.id = w.attempt_id) w ON w.exam_id = e.exam_id AND w.question_id = e.question_id GROUP BY ALL)"
expect("exam_question_stats", f"SELECT *, {FLAG} AS flag FROM {EQ}")
expect("question_flag", f"SELECT question_id, {FLAG} AS flag FROM {QS}")
SS = f"""(SELECT s.id AS student_id, count(a.id) AS attempts_total, count(*) FILTER (a.{GRADED}) AS graded, coalesce({r(f'(sum({PCT}) FILTER (a.{GRADED}))::DOUBLE / nullif(count(*) FILTER (a.{GRADED}), 0) / 1e9', 6)}, 0) AS avg_score,
  (SELECT count(*) FROM {TR} x WHERE x.student_id = s.id AND weak) AS weak_topics FROM students s LEFT JOIN (SELECT a.*, total_marks FROM attempts a JOIN exams ON exams.id = a.exam_id) a ON a.student_id = s.id GROUP BY s.id)"""
expect("student_summary", f"SELECT * FROM {SS}")
expect("weak_topics", f"SELECT student_id, subject, topic, CAST(rank() OVER (PARTITION BY student_id ORDER BY p, subject, topic) AS INTEGER) AS rank FROM {TR} WHERE weak")
expect("student_topics", f"SELECT student_id, subject, topic, CAST(rank() OVER (PARTITION BY student_id ORDER BY subject, p, topic) AS INTEGER) AS rank FROM {TR}")
expect("question_stat_lookup", "SELECT l_partkey AS question_id, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS correct FROM lineitem WHERE l_partkey = 17 AND l_returnflag <> 'N' GROUP BY 1")
expect("exam_report_detail", f"""SELECT q.exam_id, q.question_id, q.position, p_type AS subject, p_brand AS topic, q.total, if(q.total > 0, {r('q.correct * 100.0::DOUBLE / q.total')}, NULL) AS correct_percent, {r('q.avg_time')} AS avg_time, {FLAG.replace('total', 'q.total').replace('correct', 'q.correct')} AS flag, 'Exam 11' AS title, s.total_attempts, s.submitted, s.graded, s.avg_score
  FROM {EQ} q JOIN part ON p_partkey = q.question_id, (SELECT count(*) AS total_attempts, count(*) FILTER ({DONE}) AS submitted, count(*) FILTER ({GRADED}) AS graded, coalesce((sum(coalesce(score, 0)) FILTER ({GRADED}))::DOUBLE / nullif(count(*) FILTER ({GRADED}), 0), 0) AS avg_score FROM attempts WHERE exam_id = 11) s WHERE q.exam_id = 11""")
expect("student_report_detail", f"SELECT s.student_id, c_name AS name, c_mktsegment AS class_label, s.attempts_total, s.graded, {r('s.avg_score')} AS avg_percent, s.weak_topics, t.subject, t.topic, {r('t.p')} AS topic_percent FROM {SS} s JOIN customer ON c_custkey = s.student_id LEFT JOIN (SELECT * FROM {TR} WHERE weak) t ON t.student_id = s.student_id WHERE s.student_id = 42")
expect("reports_overview", f"""SELECT (SELECT count(*) FROM exams) AS exams, (SELECT count(*) FROM exams WHERE status = 'LIVE') AS live_exams, (SELECT count(*) FROM orders) AS attempts, (SELECT {MEAN.replace('status', 'a.status')} FROM attempts a JOIN exams e ON e.id = a.exam_id) AS avg_score_percent,
  (SELECT count(*) FROM {TR} WHERE weak) AS weak_topics, (SELECT count(*) FROM {QS}) AS tracked_questions, (SELECT {r('sum(correct) * 100.0::DOUBLE / sum(total)')} FROM {QS}) AS avg_accuracy_percent, (SELECT count(*) FROM customer) AS students, (SELECT count(*) FROM supplier) AS classes""")
expect("exam_reports", f"""SELECT e.id AS exam_id, e.title, (SELECT count(*) FROM {ASSIGNED} g WHERE g.exam_id = e.id) AS assigned, g.attempts, g.submitted, g.graded, g.avg_score_percent, coalesce(g.t, 0) AS avg_time_seconds, coalesce({r('g.submitted * 100.0::DOUBLE / nullif((SELECT count(*) FROM ' + ASSIGNED + ' g WHERE g.exam_id = e.id), 0)')}, 0) AS completion_percent
  FROM exams e JOIN (SELECT a.exam_id, count(*) AS attempts, count(*) FILTER ({DONE}) AS submitted, count(*) FILTER ({GRADED}) AS graded, {MEAN} AS avg_score_percent, {r('sum(spent)::DOUBLE / count(spent)')} AS t FROM (SELECT a.*, e.total_marks FROM attempts a JOIN exams e ON e.id = a.exam_id) a LEFT JOIN (SELECT attempt_id, sum(time_spent) AS spent FROM answers GROUP BY 1) w ON w.attempt_id = a.id GROUP BY 1) g ON g.exam_id = e.id
  WHERE e.opens_at < TIMESTAMP '2000-01-01' AND e.title ILIKE '%exam%'""")
expect("student_reports", f"""SELECT s.id AS student_id, s.name, coalesce(a.attempts, 0) AS attempts, coalesce(a.submitted, 0) AS submitted, coalesce(a.graded, 0) AS graded, CAST(coalesce(t.answered, 0) AS BIGINT) AS answered, coalesce(t.weak_topics, 0) AS weak_topics, coalesce(a.m, 0) AS avg_percent, coalesce(t.acc, 0) AS accuracy_percent FROM students s
  LEFT JOIN (SELECT student_id, count(*) AS attempts, count(*) FILTER ({DONE}) AS submitted, count(*) FILTER ({GRADED}) AS graded, {MEAN} AS m FROM (SELECT a.*, e.total_marks FROM attempts a JOIN exams e ON e.id = a.exam_id) GROUP BY 1) a ON a.student_id = s.id
  LEFT JOIN (SELECT student_id, sum(total) AS answered, count(*) FILTER (weak) AS weak_topics, {r('sum(correct) * 100.0::DOUBLE / sum(total)')} AS acc FROM {TR} GROUP BY 1) t ON t.student_id = s.id WHERE s.name ILIKE '%r1%' OR s.roll_no ILIKE '%r1%'""")
expect("student_trend", f"""SELECT a.student_id, a.id AS attempt_id, e.title, CAST(row_number() OVER (PARTITION BY a.student_id ORDER BY a.started_at, a.id) AS INTEGER) AS step, {r('coalesce(a.score, 0)::DOUBLE * 100 / greatest(1, e.total_marks::DOUBLE)')} AS score_percent, CAST(coalesce(t, 0) AS BIGINT) AS total_time, coalesce({r('t::DOUBLE / n')}, 0) AS avg_time, coalesce({r('k * 100.0::DOUBLE / nullif(v, 0)')}, 0) AS accuracy_percent
  FROM attempts a JOIN exams e ON e.id = a.exam_id LEFT JOIN (SELECT attempt_id, sum(time_spent) AS t, count(*) AS n, count(*) FILTER (is_correct) AS k, count(is_correct) AS v FROM answers GROUP BY 1) w ON w.attempt_id = a.id WHERE a.{GRADED}""")
ROLL = f"SELECT subject, topic, count(*) AS assessed, {r('sum(CAST(floor(p * 1e9 + 0.5) AS DECIMAL(30,0)))::DOUBLE / count(*) / 1e9')} AS avg_score_percent, {r('sum(correct) * 100.0::DOUBLE / sum(total)')} AS accuracy_percent, count(*) FILTER (weak) AS weak_students, {r('count(*) FILTER (weak) * 100.0::DOUBLE / count(*)')} AS weak_share_percent FROM {TR} {{}} GROUP BY subject, topic"
expect("topic_rollup", ROLL.format(""))
expect("topic_rollup_weak", ROLL.format("WHERE subject = 'ECONOMY'") + " HAVING count(*) FILTER (weak) > 0")
expect("question_reports", f"SELECT q.id, q.subject, q.topic, q.difficulty, s.total, {r('s.correct * 100.0::DOUBLE / s.total')} AS correct_percent, {r('s.avg_time')} AS avg_time, {FLAG.replace('total', 's.total').replace('correct', 's.correct')} AS flag FROM questions q JOIN {QS} s ON s.question_id = q.id WHERE q.name ILIKE '%ring%'")
expect("class_reports", f"""SELECT k.id AS classroom_id, k.name, coalesce(m.n, 0) AS students, coalesce(x.n, 0) AS exams_assigned, coalesce(g.attempts, 0) AS attempts, coalesce(g.submitted, 0) AS submitted, coalesce(g.m, 0) AS avg_percent, coalesce({r('g.submitted * 100.0::DOUBLE / nullif(m.n * x.n, 0)')}, 0) AS completion_percent FROM classrooms k
  LEFT JOIN (SELECT classroom_id, count(DISTINCT student_id) AS n FROM memberships GROUP BY 1) m ON m.classroom_id = k.id LEFT JOIN (SELECT classroom_id, count(DISTINCT exam_id) AS n FROM assignments WHERE classroom_id IS NOT NULL GROUP BY 1) x ON x.classroom_id = k.id
  LEFT JOIN (SELECT classroom_id, count(*) AS attempts, count(*) FILTER ({DONE}) AS submitted, {MEAN} AS m FROM (SELECT a.*, e.total_marks, z.classroom_id FROM attempts a JOIN exams e ON e.id = a.exam_id JOIN (SELECT DISTINCT exam_id, classroom_id FROM assignments WHERE classroom_id IS NOT NULL) z ON z.exam_id = a.exam_id WHERE EXISTS (SELECT 1 FROM memberships y WHERE y.classroom_id = z.classroom_id AND y.student_id = a.student_id)) GROUP BY 1) g ON g.classroom_id = k.id""")
expect("attempt_score", f"SELECT attempt_id, CAST(greatest(sum(marks_awarded), 0) AS DECIMAL(18,2)) AS score, bool_or(type = 'DESCRIPTIVE' AND NOT blank) AS descriptive_pending FROM {LAST} GROUP BY 1")
expect("exam_total_marks", "SELECT e.id AS exam_id, CAST(coalesce(sum(1 + p_size % 5), 0) AS DECIMAL(18,2)) AS total_marks FROM exams e LEFT JOIN exam_questions x ON x.exam_id = e.id LEFT JOIN part ON p_partkey = x.question_id GROUP BY 1")
expect("paper_total_marks", "SELECT CAST(n_nationkey AS BIGINT) AS paper_id, CAST(coalesce(sum(1 + p_size % 5), 0) AS DECIMAL(18,2)) AS total_marks FROM nation LEFT JOIN part ON p_partkey % 20 = n_nationkey GROUP BY 1")
expect("drafts_by_status", "SELECT s.status, (SELECT count(*) FROM drafts d WHERE d.status = s.status AND d.job_id = 3) AS n FROM (VALUES ('PENDING'), ('EDITED'), ('APPROVED'), ('DISCARDED')) s(status)")
expect("job_finalised", "SELECT job_id, count(*) = count(*) FILTER (status IN ('APPROVED', 'DISCARDED')) AS finalised FROM drafts GROUP BY 1")
expect("batch_list", "SELECT u.batch_id, count(*) AS files, CAST(coalesce(sum((SELECT count(*) FROM drafts d WHERE d.job_id = u.id)), 0) AS BIGINT) AS drafts, count(*) FILTER (status = 'READY') AS completed, count(*) FILTER (status = 'FAILED') AS failed, bool_or(status = 'PROCESSING') AS processing, arg_min(u.id, (u.batch_order, u.id)) AS first_id FROM uploads u WHERE batch_id IS NOT NULL GROUP BY 1")
expect("batch_progress", "SELECT batch_id, count(*) FILTER (status IN ('PENDING', 'UPLOADED')) AS queued, count(*) FILTER (status = 'PROCESSING') AS processing, count(*) FILTER (status = 'READY') AS completed, count(*) FILTER (status = 'FAILED') AS failed, coalesce(min(id) FILTER (status = 'PROCESSING'), min(id) FILTER (status IN ('PENDING', 'UPLOADED'))) AS current_id FROM uploads WHERE batch_id IS NOT NULL GROUP BY 1")
expect("job_progress", "SELECT id, CAST(CASE WHEN status IN ('READY', 'FAILED') THEN 100 WHEN id % 9 > 0 THEN least(99, floor((batch_order % 7) * 100.0::DOUBLE / (id % 9) + 0.5)) WHEN status IN ('UPLOADED', 'PROCESSING') THEN 5 ELSE 0 END AS INTEGER) AS percent FROM uploads")
expect("paper_summary", "SELECT 25::BIGINT AS total, count(*) FILTER (n_nationkey % 3 = 0) AS draft, count(*) FILTER (n_nationkey % 3 = 1) AS published, count(*) FILTER (n_nationkey % 3 = 2) AS archived FROM nation")
expect("composition_summary", "SELECT count(*) AS total, count(*) FILTER (id NOT IN (SELECT paper_id FROM paper_questions)) AS empty, count(*) FILTER (id IN (SELECT paper_id FROM paper_questions)) AS composed, count(*) FILTER (id < 9) AS in_use FROM papers")
expect("paper_rows", "SELECT p.id, p.title, (SELECT count(*) FROM paper_questions l WHERE l.paper_id = p.id) AS questions, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT p_type AS s FROM part WHERE p_partkey % 20 = p.id UNION SELECT 'General' WHERE p.id % 4 = 0)), '') AS subjects FROM papers p")
expect("classroom_rows", "SELECT id, name, (SELECT count(*) FROM memberships m WHERE m.classroom_id = k.id) AS students, (SELECT count(*) FROM assignments a WHERE a.classroom_id = k.id) AS assignments FROM classrooms k")
expect("upload_rows", "SELECT u.id, count(d.id) AS drafts, count(*) FILTER (d.status = 'APPROVED') AS approved FROM uploads u LEFT JOIN drafts d ON d.job_id = u.id GROUP BY 1")
expect("classroom_facets", "SELECT 'name' AS facet, name AS value FROM classrooms UNION SELECT 'year', year::VARCHAR FROM classrooms UNION SELECT 'section', section FROM classrooms UNION SELECT 'subject', subject FROM classrooms WHERE subject IS NOT NULL")
expect("dashboard_summary", f"""SELECT (SELECT count(*) FROM exams WHERE status = 'LIVE') AS live_exams, (SELECT count(*) FROM exams WHERE status = 'SCHEDULED') AS scheduled_exams, (SELECT count(*) FROM exams WHERE TIMESTAMP '1997-01-01' BETWEEN opens_at AND closes_at) AS open_today, (SELECT max(opens_at) FROM exams WHERE status = 'LIVE') AS latest_opening,
  (SELECT count(*) FROM attempts WHERE status = 'IN_PROGRESS') AS running_attempts, (SELECT count(*) FROM attempts WHERE status = 'SUBMITTED') AS awaiting_grading, (SELECT count(*) FROM attempts WHERE status = 'FLAGGED') AS flagged_attempts, (SELECT count(*) FROM attempts WHERE submitted_at >= TIMESTAMP '1996-12-25' AND submitted_at < TIMESTAMP '1997-01-01') AS submitted_last_week,
  (SELECT count(*) FROM uploads WHERE status = 'PROCESSING') AS uploads_processing, (SELECT count(*) FROM uploads WHERE status = 'FAILED') AS uploads_failed, (SELECT count(*) FROM drafts WHERE status IN ('PENDING', 'EDITED')) AS drafts_to_review, (SELECT count(*) FROM customer) AS students, (SELECT count(*) FROM supplier) AS classrooms, (SELECT count(*) FROM part WHERE p_size % 10 <> 0) AS active_questions,
  (SELECT count(*) FROM papers WHERE status = 'PUBLISHED') AS published_papers, (SELECT count(*) FROM events WHERE NOT value > 10) AS unread_notifications, (SELECT count(*) FROM {TR} WHERE weak) AS weak_topics""")
expect("notification_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (value <= 10) AS unread FROM events GROUP BY 1")
expect("violation_counts", "SELECT user_id AS attempt_id, if(event_type = 'error', 'TAB_SWITCH', upper(event_type)) AS type, count(*) AS n FROM events GROUP BY ALL")
expect("violation_totals", "SELECT user_id AS attempt_id, count(*) AS n FROM events GROUP BY 1")
expect("status_counts_ladder", "SELECT count(*) AS n0, count(score) AS n1, count(score) FILTER (exam_id < 25) AS n2, count(score) FILTER (exam_id < 25 AND score > 1000) AS n3 FROM attempts")

# --- sequences, order, sets
expect("w_batch_sequence", "SELECT job_id % 20 AS batch, id, row_number() OVER (PARTITION BY job_id % 20 ORDER BY position, id) AS seq FROM drafts")
expect("w_positions", "SELECT job_id, id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY question_number NULLS LAST, position, id) - 1 AS INTEGER) AS place FROM drafts")
expect("w_append_pos", "SELECT q.id % 25 AS paper_id, q.id AS question_id, CAST(coalesce((SELECT max(position) FROM paper_questions l WHERE l.paper_id = q.id % 25), -1) + row_number() OVER (PARTITION BY q.id % 25 ORDER BY q.id) AS BIGINT) AS position FROM questions q WHERE subject = 'PROMO'")
expect("w_draft_position", "SELECT job_id, id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY id % 5, question_number % 2 NULLS FIRST, position, id) - 1 AS INTEGER) AS place FROM drafts")
expect("w_roll_numbers", "SELECT id, coalesce(roll_no, '24' || upper(substr(class_label, 1, 2)) || 'A' || CASE WHEN k < 10 THEN '0' || k ELSE k::VARCHAR END) AS roll_no FROM (SELECT *, count(roll_no) OVER (PARTITION BY class_label) + count(*) FILTER (roll_no IS NULL) OVER (PARTITION BY class_label ORDER BY id) AS k FROM students)")
expect("w_gap_neighbours", "SELECT j.job_id, g AS missing, (SELECT max(question_number) FROM drafts d WHERE d.job_id = j.job_id AND question_number < g) AS previous, (SELECT min(question_number) FROM drafts d WHERE d.job_id = j.job_id AND question_number > g) AS next FROM (SELECT job_id, unnest(range(min(question_number), max(question_number) + 1)) AS g FROM drafts GROUP BY 1) j WHERE NOT EXISTS (SELECT 1 FROM drafts d WHERE d.job_id = j.job_id AND d.question_number = g)")
expect("w_monotone_run", "SELECT id, job_id, CAST(question_number AS INTEGER) AS question_number FROM drafts d QUALIFY question_number IS NULL OR question_number > coalesce(max(question_number) OVER (PARTITION BY job_id ORDER BY position, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")
expect("w_latest_per_key", "SELECT student_id, arg_max(classroom_id, (joined_at, classroom_id)) AS classroom_id, max(joined_at) AS joined_at FROM memberships GROUP BY 1")
expect("w_after_marker", "SELECT d.id, d.position > coalesce((SELECT min(position) FROM drafts x WHERE x.job_id = d.job_id AND x.status = 'DISCARDED'), 9223372036854775807) AS after_marker FROM drafts d")
expect("sort_enum_nulls", "SELECT id, CAST(row_number() OVER (ORDER BY CASE status WHEN 'DRAFT' THEN 0 WHEN 'SCHEDULED' THEN 1 WHEN 'LIVE' THEN 2 ELSE 3 END, opens_at NULLS LAST, id) AS INTEGER) AS place FROM exams")
expect("topk_review_queue", "SELECT id, job_id FROM drafts WHERE status = 'PENDING' OR status = 'EDITED' ORDER BY position DESC, id DESC LIMIT 6")
expect("topk_todays_exams", "SELECT id, status FROM exams WHERE TIMESTAMP '1997-01-01' BETWEEN opens_at AND closes_at ORDER BY id % 4, opens_at, id LIMIT 6")
expect("top1_latest_published", "SELECT max(o_orderdate) AS latest FROM (SELECT min(o_orderdate) AS o_orderdate FROM orders WHERE o_orderkey % 50 % 4 = 2 GROUP BY o_orderkey % 50)")
expect("offset_pagination", "SELECT id, status, (SELECT count(*) FROM documents) AS total FROM uploads ORDER BY created_at DESC, id LIMIT 200 OFFSET 100")
expect("sweep_cap", f"SELECT id, 'SUBMITTED' AS status FROM ({EXPIRED.format('1997-01-01')}) ORDER BY started_at, id LIMIT 100")
expect("random_draw", """, open AS (SELECT id, subject, difficulty, md5('11:' || id) AS h FROM questions WHERE is_active),
  a AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS place FROM open WHERE subject = 'ECONOMY' QUALIFY place < 5),
  b AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS place FROM open WHERE difficulty = 'HARD' AND id NOT IN (SELECT id FROM a) QUALIFY place < 7),
  d AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS place FROM open WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) QUALIFY place < 3)
  SELECT 0 AS rule, CAST(place AS INTEGER) AS place, id FROM a UNION ALL SELECT 1, CAST(place AS INTEGER), id FROM b UNION ALL SELECT 2, CAST(place AS INTEGER), id FROM d""")
expect("seeded_order", "SELECT exam_id, question_id, CAST(row_number() OVER (PARTITION BY exam_id ORDER BY md5(exam_id || ':' || question_id), question_id) - 1 AS INTEGER) AS place FROM exam_questions WHERE exam_id < 5")
expect("unseeded_shuffle", "SELECT id, '1,2,3,4,5,6' AS sorted FROM exams")
expect("assignment_expand", f"SELECT exam_id, student_id FROM {ASSIGNED}")
expect("attempt_fanout", f"SELECT exam_id, student_id FROM {ASSIGNED} EXCEPT SELECT exam_id, student_id FROM attempts")
expect("notify_fanout", "SELECT c_custkey AS student_id, unnest(['EMAIL', 'IN_APP']) AS channel FROM customer WHERE c_nationkey = 2")
expect("tagged_lists", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, 'paper' AS list FROM nation UNION ALL SELECT id, 'Exam ' || id, 'exam' FROM exams WHERE id % 3 = 0")
expect("subject_union", "SELECT p.id AS paper_id, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT p_type AS s FROM part WHERE p_partkey % 20 = p.id UNION SELECT 'Extra' WHERE p.id % 2 = 0)) AS subjects FROM papers p WHERE p.id < 20 OR p.id % 2 = 0")
expect("duplicate_agreement", "SELECT attempt_id, question_id, count(*) AS n, if(bool_and(is_correct) OR NOT bool_or(is_correct), 'identical', 'conflict') AS state FROM answers WHERE is_correct IS NOT NULL GROUP BY ALL HAVING count(*) > 1")

# --- scalar functions
expect("fn_strings", "SELECT p_partkey AS id, upper(p_name) AS up, split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1) AS swapped, left(p_name, 3) AS head, lpad((p_partkey % 100)::VARCHAR, 3, '0') AS padded, replace(p_name, 'ring', 'RING') AS replaced, p_name LIKE 'red%' AS is_red FROM part")
expect("fn_html", "SELECT p_partkey AS id, '&lt;b&gt;' || p_name || ' &amp; co&lt;/b&gt;' AS escaped, p_name || '<br/>&lt;' AS broken FROM part")
expect("fn_templates", r"""SELECT id, 'Hello Ann,' || chr(10) || 'A new exam "Exam ' || id || '" has been scheduled.' || chr(10) || 'Duration: ' || (30 + 10 * (id % 7)) || ' minutes' || if(id % 2 = 0, chr(10) || 'Opens: ' || strftime(opens_at, '%Y-%m-%d'), '') AS body FROM exams""")
expect("fn_regex", "SELECT o_orderkey AS id, CAST(nullif(o_orderkey % 300, 0) AS INTEGER) AS number, CAST(length(regexp_replace((o_orderkey % 300) || '. What is ' || o_orderpriority || '?', '[^aeiou]', '', 'g')) AS INTEGER) AS vowels FROM orders")
expect("fn_dates", "SELECT event_id AS id, date_trunc('day', ts)::TIMESTAMP AS day, ts + INTERVAL 7 DAY AS week_on, CAST(floor(epoch(date_trunc('second', ts)) / 30) AS BIGINT) AS bucket FROM events")
expect("fn_math", f"SELECT p_partkey AS id, {r('p_retailprice / 7', 3)} AS third, CASE WHEN p_size < 5 THEN 5 WHEN p_size > 40 THEN 40 ELSE p_size END AS clamped, abs(p_size - 25) AS away FROM part")
expect("fn_decimals", "SELECT p_partkey AS id, CAST(1 + p_size % 5 - (p_size % 3) * 0.25 AS DECIMAL(8,2)) AS less, CAST((p_size % 3) * -0.25 AS DECIMAL(8,2)) AS negated, p_size % 5 < 2 AS few FROM part")
expect("fn_bits", "SELECT p_partkey AS id, xor(p_partkey, p_partkey * 8) AS mixed, p_partkey // 4 AS right, p_partkey % 8 AS low FROM part")
expect("fn_arrays", "SELECT p_partkey AS id, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sorted, list_contains(string_split(p_name, ' '), 'ring') AS has_ring, CAST(length(replace(p_name, ' ', '')) AS INTEGER) AS letters FROM part")
expect("fn_maps", "SELECT p_partkey AS id, 2 AS n, p_size + 1 AS b, 'a,b' AS keys FROM part")
expect("fn_json", "SELECT event_id AS id, CAST(props->>'k' AS INTEGER) AS k, props->>'none' AS none FROM events")
expect("fn_types", "SELECT event_id AS id, coalesce(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'), false) AS is_number, json_exists(props, '$.k') AS present FROM events")
FIRST_WORDS = ", firsts AS (SELECT DISTINCT regexp_extract(text, '^[\\p{L}]+') AS word FROM documents WHERE regexp_matches(text, '^\\p{L}'))"
expect("fn_locale", f"""{FIRST_WORDS} SELECT word, min(word) OVER (PARTITION BY lower(strip_accents(word))) AS letters, min(word) OVER (PARTITION BY lower(word)) AS folded, count(*) OVER (PARTITION BY lower(strip_accents(word))) AS same FROM firsts""")
expect("locale_equal", f"""{FIRST_WORDS}, names AS (SELECT unnest(string_split(name, ' ')) AS name FROM questions UNION SELECT lower(word) FROM firsts) SELECT word, count(*) AS n FROM firsts JOIN names ON lower(names.name) = lower(word) GROUP BY word""")
expect("fn_hash", "SELECT p_partkey AS id, sha256(p_name) AS sha, md5(p_brand) AS md5 FROM part")

# --- grading
for _name, _type in (("grade_single", "SINGLE_CHOICE"), ("grade_visual", "VISUAL"), ("grade_true_false", "TRUE_FALSE"), ("grade_multiple", "MULTIPLE_CHOICE"), ("grade_fill_blank", "FILL_BLANK"), ("grade_match", "MATCH_FOLLOWING"), ("grade_matrix", "MATRIX_MATCH"), ("grade_descriptive", "DESCRIPTIVE")):
    expect(_name, f"SELECT attempt_id, question_id, line_no, time_spent, is_correct, CAST(marks_awarded AS DECIMAL(7,2)) AS marks_awarded FROM marked WHERE type = '{_type}'")
expect("grade_blank", "SELECT type, false AS is_correct, 0::DECIMAL(7,2) AS marks_awarded, count(*) AS n FROM marked WHERE blank AND type <> 'DESCRIPTIVE' GROUP BY 1")
expect("grade_dispatch", "SELECT type, is_correct, count(*) AS n, CAST(sum(marks_awarded) AS DECIMAL(18,2)) AS marks FROM marked GROUP BY ALL")

# --- answer keys and page texts
KEYS = "(SELECT attempt_id AS doc_id, CAST(question_id % 12 AS INTEGER) AS number, ['1','2','3','4','Z'][time_spent % 5 + 1] AS answer FROM answers)"
PARSED = f"""(SELECT doc_id, number, if(number < 1 OR min(answer) <> max(answer), NULL, min(answer)) AS answer, count(*) AS n, CASE WHEN number < 1 THEN 'rejected' WHEN min(answer) <> max(answer) THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'entry' END AS state FROM {KEYS} WHERE answer <> 'Z' GROUP BY doc_id, number
  UNION ALL SELECT doc_id, number, if(number < 1, NULL, 'Z'), count(*), if(number < 1, 'rejected', 'invalid') FROM {KEYS} k WHERE answer = 'Z' AND NOT EXISTS (SELECT 1 FROM {KEYS} x WHERE x.doc_id = k.doc_id AND x.number = k.number AND x.answer <> 'Z') GROUP BY doc_id, number)"""
expect("key_pairs", f"SELECT doc_id, number, answer, count(*) AS n FROM {KEYS} WHERE answer <> 'Z' GROUP BY ALL")
expect("key_count", f"SELECT doc_id, CAST(count(*) FILTER (answer <> 'Z') AS INTEGER) AS pairs FROM {KEYS} GROUP BY 1")
expect("key_parse", f"SELECT * FROM {PARSED}")
_of = lambda cond: f"coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER ({cond}), '')"
expect("key_report", f"""SELECT p.doc_id, CAST(count(*) FILTER (state IN ('entry', 'duplicate')) AS INTEGER) AS entries, coalesce(min(number) FILTER (state IN ('entry', 'duplicate')), 1) = 1 AS starts_at_one,
  coalesce((SELECT string_agg(g::VARCHAR, ',' ORDER BY g) FROM range(1, 12) t(g) WHERE g < max(p.number) FILTER (p.state IN ('entry', 'duplicate')) AND g NOT IN (SELECT number FROM {PARSED} x WHERE x.doc_id = p.doc_id AND x.state IN ('entry', 'duplicate'))), '') AS missing,
  {_of("n > 1 AND state IN ('duplicate', 'conflict')")} AS duplicates, {_of("state = 'conflict'")} AS conflicts, {_of("state = 'invalid'")} AS invalid, {_of("state = 'rejected'")} AS rejected FROM {PARSED} p GROUP BY p.doc_id""")
expect("draft_number", "SELECT o_orderkey AS id, CAST(nullif(o_orderkey % 300, 0) AS INTEGER) AS number FROM orders")
KD = "(SELECT o_orderkey AS id, CAST(if(o_custkey % 5 = 0, nullif(o_orderkey % 300, 0), (o_custkey % 180 + 1) % 12) AS INTEGER) AS number, greatest(o_custkey % 7, o_custkey % 5) AS bound FROM orders)"
ASSIGN = f"(SELECT d.id AS doc_id, d.id AS draft_id, d.number, if(e.answer IS NULL OR (bound > 0 AND e.answer::INTEGER > bound), NULL, e.answer) AS answer, CASE WHEN e.answer IS NULL THEN 'unmatched' WHEN bound > 0 AND e.answer::INTEGER > bound THEN 'out_of_range' ELSE 'assigned' END AS state FROM {KD} d LEFT JOIN (SELECT * FROM {PARSED} WHERE state IN ('entry', 'duplicate')) e ON e.doc_id = d.id AND e.number = d.number)"
expect("key_assign", f"SELECT * FROM {ASSIGN} UNION ALL SELECT e.doc_id, NULL, e.number, e.answer, 'unused' FROM {PARSED} e WHERE state IN ('entry', 'duplicate') AND NOT EXISTS (SELECT 1 FROM {ASSIGN} a WHERE a.doc_id = e.doc_id AND a.number = e.number AND a.state = 'assigned')")
expect("page_classify", """SELECT doc_id // 10 AS doc_id, CAST(doc_id % 10 + 1 AS INTEGER) AS page, v.type, v.confidence::DOUBLE AS confidence, v.words, v.markers, v.needs_review FROM documents JOIN
  (VALUES (0, 'INSTRUCTION', 0.92, 9, 0, false), (1, 'INSTRUCTION', 0.65, 3, 0, false), (2, 'QUESTION', 0.95, 32, 4, false), (3, 'QUESTION', 0.73, 12, 1, false), (4, 'UNKNOWN', 0.5, 90, 0, true), (5, 'UNKNOWN', 0.3, 20, 0, false), (6, 'OMR', 0.85, 5, 0, false), (7, 'ANSWER_KEY', 0.85, 14, 0, false), (8, 'ANSWER_KEY', 0.85, 32, 0, false), (9, 'UNKNOWN', 0.3, 10, 0, false)) v(k, type, confidence, words, markers, needs_review) ON v.k = doc_id % 10""")
expect("page_extractable", "SELECT doc_id // 10 AS doc_id, CAST(doc_id % 10 + 1 AS INTEGER) AS page FROM documents WHERE doc_id % 10 IN (2, 3, 4)")
expect("page_tally", "SELECT doc_id // 10 AS doc_id, count(*) FILTER (doc_id % 10 IN (0, 1)) AS instruction, count(*) FILTER (doc_id % 10 IN (2, 3)) AS question, count(*) FILTER (doc_id % 10 IN (7, 8)) AS answer_key, count(*) FILTER (doc_id % 10 = 6) AS omr, count(*) FILTER (doc_id % 10 IN (4, 5, 9)) AS unknown, count(*) FILTER (doc_id % 10 = 4) AS needs_review FROM documents GROUP BY 1")
expect("key_page_type", "SELECT doc_id // 6 AS doc_id, CAST(doc_id % 6 + 1 AS INTEGER) AS page, ['OTHER','ANSWER_KEY','OTHER','SOLUTION','ANSWER_KEY','ANSWER_KEY'][doc_id % 6 + 1] AS type, [0,8,3,1,8,8][doc_id % 6 + 1] AS pairs, [30,8,43,6,8,8][doc_id % 6 + 1] AS words, if(doc_id % 6 = 3, 3, 0) AS solution_hits FROM documents")
expect("key_page_select", "SELECT doc_id // 6 AS doc_id, CAST(doc_id % 6 + 1 AS INTEGER) AS page FROM documents d WHERE doc_id % 6 IN (1, 2)")
expect("parse_drafts", """SELECT doc_id AS id, v.position, replace(v.text, '#', doc_id::VARCHAR) AS text, v.type, replace(v.options, '#', doc_id::VARCHAR) AS options, v.solution, v.needs_review FROM documents, (VALUES (0, 'What is item #?', 'SINGLE_CHOICE', 'red|blue # more', '', false), (1, 'Pick the right one of these', 'SINGLE_CHOICE', 'cat|dog|cow #', '', false), (2, 'Explain why item # is so very heavy today', 'DESCRIPTIVE', '', 'it is lead and gold', false)) v(position, text, type, options, solution, needs_review)""")
expect("split_inline_markers", "SELECT doc_id AS id, unnest(['12. The first of the two questions that one line has come to hold ' || doc_id, '13. Second of them stands here']) AS part FROM documents")
expect("inline_options", "SELECT doc_id AS id, 'Pick one of item ' || doc_id AS stem, 'cat (l) x|dog|cow' AS options FROM documents")
expect("strip_garbage", "SELECT doc_id AS id, 'its value ' || doc_id || 'kg end of an A B' AS text, true AS stripped FROM documents WHERE doc_id > 9 UNION ALL SELECT doc_id, 'its value ' || doc_id || 'kg end of an A B', true FROM documents WHERE doc_id <= 9")
expect("infer_type", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'MULTIPLE_CHOICE' WHEN 1 THEN 'FILL_BLANK' WHEN 2 THEN 'TRUE_FALSE' ELSE if(o_custkey % 7 >= 2, 'SINGLE_CHOICE', 'DESCRIPTIVE') END AS type FROM orders")
expect("draft_html", "SELECT id, '<p>' || text || '</p><p>&lt;i&gt; &amp; more</p>' AS html FROM drafts")
expect("noise_stem", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS corrupted FROM orders")

# --- words on pages
WORDS = """, once AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber AS k, max({'q': l_quantity, 'e': l_extendedprice}) AS m FROM lineitem GROUP BY ALL),
placed AS (SELECT *, CAST(m.e AS BIGINT) AS wrong, CAST(floor(m.e) AS BIGINT) % 260 AS x FROM once),
words AS (SELECT l_suppkey AS job_id, l_orderkey % 10 AS page, l_orderkey * 1000000 + l_partkey * 10 + k AS word_id,
  CASE k WHEN 1 THEN (l_orderkey % 60 + 1) || '.' WHEN 2 THEN '(' || (l_partkey % 4 + 1) || ')' WHEN 3 THEN chr(CAST(65 + l_partkey % 4 AS INTEGER)) || '.' WHEN 4 THEN if(l_partkey % 2 = 0, 'True', 'false') WHEN 5 THEN 'word' || (l_partkey % 50) WHEN 6 THEN 'diagram' ELSE '@' END AS text, k,
  CAST(CASE WHEN k = 1 THEN if(l_suppkey % 3 = 0, 0, l_partkey % 2 * 300) WHEN l_suppkey % 3 <> 0 AND k % 2 = 0 THEN x + 300 ELSE x END AS DOUBLE) AS x0, m.q * 16 AS y0, x0 + 20 + l_partkey % 20 AS x1, m.q * 16 + 12 AS y1, CAST(CAST(m.q AS BIGINT) % 10 AS DOUBLE) / 10 AS conf, (x0 + x0 + 20 + l_partkey % 20) / 2 AS cx, m.q * 16 + 6 AS cy FROM placed),
starts AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM words o WHERE o.job_id = w.job_id AND o.page = w.page AND o.y0 = w.y0 AND o.word_id <> w.word_id AND o.x1 <= w.x0 AND w.x0 - o.x1 < 24)),
numbers AS (SELECT *, CAST(replace(text, '.', '') AS INTEGER) AS num FROM starts WHERE k = 1),
sides AS (SELECT *, count(*) FILTER (jump) OVER (PARTITION BY job_id, page ORDER BY x0, word_id) AS col FROM (SELECT *, coalesce(x0 - lag(x0) OVER (PARTITION BY job_id, page ORDER BY x0, word_id) > 60, false) AS jump FROM numbers)),
kept AS (SELECT * FROM sides QUALIFY num > coalesce(max(num) OVER (PARTITION BY job_id, page, col ORDER BY y0, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
lefts AS (SELECT job_id, page, col, min(x0) AS lft, coalesce(lead(min(x0)) OVER (PARTITION BY job_id, page ORDER BY col), 600) AS rgt FROM sides GROUP BY 1, 2, 3),
boxes AS (SELECT job_id, page, col, CAST(row_number() OVER w - 1 AS INTEGER) AS place, greatest(0, floor(lft - 5 + 0.5)) AS x0, greatest(0, y - 5) AS y0, least(600, rgt) AS x1, coalesce(lead(y) OVER w - 5, 820) AS y1 FROM (SELECT DISTINCT job_id, page, col, y0 AS y FROM kept) JOIN lefts USING (job_id, page, col) WINDOW w AS (PARTITION BY job_id, page, col ORDER BY y))"""


def on_words(name, body):
    expect(name, f"{WORDS} {body}")


on_words("topk_figure_pages", "SELECT job_id, page, count(*) FILTER (k = 6) AS figures FROM words GROUP BY 1, 2 ORDER BY figures DESC, job_id, page LIMIT 5")
on_words("watermark_tokens", "SELECT job_id, page, lower(text) AS token FROM words WHERE length(text) BETWEEN 2 AND 30 AND (SELECT count(*) FROM words p WHERE p.job_id = words.job_id AND p.page = words.page) >= 30 GROUP BY ALL HAVING count(*) >= 3 AND max(cx) - min(cx) <= 200 AND max(cy) - min(cy) >= 100")
on_words("column_split", f"""SELECT job_id, page, {r('lo + (bin + 0.5) / 40 * (hi - lo)', 4)} AS split_x, {r('least(0.98, 0.6 + (0.18 - k / mean) * 2)', 6)} AS confidence FROM (
  SELECT e.job_id, e.page, lo, hi, b AS bin, coalesce(c.k, 0) AS k, (sum(coalesce(c.k, 0)) FILTER (b BETWEEN 4 AND 35) OVER (PARTITION BY e.job_id, e.page))::DOUBLE / 32 AS mean FROM (SELECT job_id, page, min(cx) AS lo, max(cx) AS hi FROM words GROUP BY 1, 2 HAVING count(*) >= 30 AND max(cx) > min(cx)) e CROSS JOIN range(40) t(b)
  LEFT JOIN (SELECT w.job_id, w.page, least(39, floor((cx - lo) / (hi - lo) * 40)) AS bin, count(*) AS k FROM words w JOIN (SELECT job_id, page, min(cx) AS lo, max(cx) AS hi FROM words GROUP BY 1, 2) e USING (job_id, page) GROUP BY 1, 2, 3) c ON c.job_id = e.job_id AND c.page = e.page AND c.bin = b)
  WHERE bin BETWEEN 12 AND 27 QUALIFY row_number() OVER (PARTITION BY job_id, page ORDER BY k, bin) = 1 AND k / mean <= 0.18""")
on_words("word_lines", "SELECT job_id, page, CAST(dense_rank() OVER (PARTITION BY job_id, page ORDER BY y0) AS INTEGER) AS line, count(*) AS n FROM words GROUP BY job_id, page, y0")
on_words("line_start", "SELECT job_id, page, word_id FROM starts")
on_words("question_punct", "SELECT DISTINCT job_id, page, '.' AS q_punct FROM numbers")
on_words("markers", "SELECT job_id, page, word_id, num FROM numbers")
on_words("detect_columns", "SELECT job_id, page, word_id, CAST(col AS INTEGER) AS col, lft AS left, CAST(rgt AS DOUBLE) AS right FROM sides JOIN lefts USING (job_id, page, col)")
on_words("sequence_validate", "SELECT job_id, page, word_id, num FROM kept")
on_words("build_regions", "SELECT job_id, page, CAST(col AS INTEGER) AS col, place, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM boxes WHERE y1 - y0 >= 12 AND x1 - x0 >= 12")
on_words("words_in_region", "SELECT b.job_id, b.page, CAST(b.col AS INTEGER) AS col, b.place, count(*) AS n FROM boxes b JOIN words w ON w.job_id = b.job_id AND w.page = b.page AND w.cx >= b.x0 AND w.cx < b.x1 AND w.cy >= b.y0 AND w.cy < b.y1 WHERE b.y1 - b.y0 >= 12 AND b.x1 - b.x0 >= 12 GROUP BY ALL")
LABELS = "(count(DISTINCT text) FILTER (k = 2) + count(DISTINCT text) FILTER (k = 3) + if(job_id % 2 = 0, count(DISTINCT text) FILTER (k = 1), 0))"
TF = "(bool_or(text = 'True') AND bool_or(text = 'false'))"
#: The highest answer label of a page, and the words above it.
BLOCKS = f", tops AS (SELECT job_id, page, min(y0) FILTER (k IN (2, 3, 4) OR (k = 1 AND job_id % 2 = 0)) AS top FROM words GROUP BY 1, 2), stems AS (SELECT w.job_id, w.page, count(*) FILTER (s) AS n, coalesce(sum(length(text)) FILTER (s), 0) AS chars FROM (SELECT w.*, (top IS NULL OR y0 < top - 1) AND k IN (5, 6) AS s FROM words w JOIN tops USING (job_id, page)) w GROUP BY 1, 2)"
KIND = f"CASE WHEN {TF} THEN 'TRUE_FALSE' WHEN {LABELS} >= 2 THEN 'MCQ' WHEN bool_or(k = 6) THEN 'DIAGRAM_BASED' ELSE 'UNKNOWN' END"
on_words("block_class", f"SELECT job_id, page, {KIND} AS kind FROM words GROUP BY 1, 2")
on_words("has_stem", f"{BLOCKS} SELECT job_id, page, n >= 2 OR chars >= 8 AS stem FROM stems")
on_words("complete_block", f"{BLOCKS} SELECT w.job_id, w.page, if(any_value(answered), any_value(n >= 2 OR chars >= 8), any_value(kind) = 'DIAGRAM_BASED' AND any_value(size) >= 6) AS complete FROM (SELECT job_id, page, {TF} OR {LABELS} >= 2 AS answered, {KIND} AS kind, count(*) AS size FROM words GROUP BY 1, 2) w JOIN stems USING (job_id, page) GROUP BY 1, 2")
on_words("option_markers", f"SELECT job_id, page, CAST({LABELS} AS INTEGER) AS labels, CAST(if(n BETWEEN 2 AND 6, n, 4) AS INTEGER) AS options FROM (SELECT *, count(DISTINCT lower(regexp_replace(text, '[().]', '', 'g'))) FILTER (k IN (2, 3)) OVER (PARTITION BY job_id, page) AS n FROM words) GROUP BY job_id, page, n")
on_words("region_confidence", f"SELECT job_id, page, word_id, {r('greatest(0.1, 1 - if(word_id % 4 < 2, 0.25, 0) - if(word_id % 9 < 5, 0.25, 0) - if(y0 > 820 * 0.85, 0.2, 0) - if(word_id % 2 = 0 AND y1 + 8 >= 818, 0.2, 0))::DOUBLE', 2)} AS confidence FROM words")
expect("quality_report", """, v AS (SELECT job_id, count(*) FILTER (id % 11 <> 0) AS detected, count(*) FILTER (id % 11 = 0) AS invalid, CAST(min(question_number) FILTER (id % 11 <> 0) AS INTEGER) AS lo, CAST(max(question_number) FILTER (id % 11 <> 0) AS INTEGER) AS hi, list_sort(list(question_number) FILTER (id % 11 <> 0 AND question_number IS NOT NULL)) AS ns FROM drafts GROUP BY 1)
  SELECT job_id, detected, invalid, lo, hi, coalesce(array_to_string(list_filter(range(lo, hi + 1), lambda g: NOT list_contains(ns, g)), ','), '') AS missing, array_to_string(list_filter(list_sort(list_distinct(coalesce(ns, []))), lambda g: len(list_filter(ns, lambda x: x = g)) > 1), ',') AS duplicates,
  CAST(coalesce(floor(len(list_distinct(ns)) * 100.0::DOUBLE / (hi - lo + 1) + 0.5), 100) AS INTEGER) AS coverage_pct FROM v""")
on_words("figure_attach_region", """, ds AS (SELECT job_id, page, word_id AS place, row_number() OVER (PARTITION BY job_id, page ORDER BY word_id) - 1 AS i, count(*) OVER (PARTITION BY job_id, page) AS n FROM words WHERE text LIKE '%.' AND y0 < 400),
ts AS (SELECT job_id, page, y0, y1, row_number() OVER (PARTITION BY job_id, page ORDER BY word_id, y0, y1) - 1 AS j, count(*) OVER (PARTITION BY job_id, page) AS t FROM words WHERE k = 5),
spans AS (SELECT d.job_id, d.page, d.place, d.i, CASE WHEN any_value(z.t) IS NULL THEN 0 ELSE coalesce(min(t.y0), 0) END AS lo, CASE WHEN any_value(z.t) IS NULL THEN 9007199254740991.0 ELSE coalesce(max(t.y1), 0) END AS hi FROM ds d LEFT JOIN (SELECT DISTINCT job_id, page, t FROM ts) z ON z.job_id = d.job_id AND z.page = d.page LEFT JOIN ts t ON t.job_id = d.job_id AND t.page = d.page AND t.j >= d.i * t.t // d.n AND t.j < greatest(d.i * t.t // d.n + 1, (d.i + 1) * t.t // d.n) GROUP BY 1, 2, 3, 4)
SELECT f.job_id, f.page, f.word_id AS figure_id, arg_min(s.place, (-greatest(0, least(f.y1, s.hi) - greatest(f.y0, s.lo)), abs((s.lo + s.hi) / 2 - (f.y0 + f.y1) / 2), s.i)) AS place FROM words f JOIN spans s ON s.job_id = f.job_id AND s.page = f.page WHERE f.k = 6 GROUP BY 1, 2, 3""")
on_words("figure_attach_stripe", """, ds AS (SELECT job_id, page, list_sort(list(word_id)) AS l FROM words WHERE text LIKE '%.' AND y0 < 400 GROUP BY 1, 2) SELECT f.job_id, f.page, f.word_id AS figure_id, l[CAST(least(len(l) - 1, floor(least(1, f.cy / 820.0::DOUBLE) * len(l))) AS BIGINT) + 1] AS place FROM words f JOIN ds ON ds.job_id = f.job_id AND ds.page = f.page WHERE f.k = 6""")
on_words("region_quality", f"SELECT job_id, page, {r('(sum(CAST(round(conf * 1000000) AS BIGINT)) / 1000000::DOUBLE / count(*)) * (0.7 + 0.3 * least(1, sum(CASE k WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN length(text) WHEN 5 THEN 4 WHEN 6 THEN 7 ELSE 0 END)::DOUBLE / sum(length(text)) * 1.25))', 4)} AS quality FROM words GROUP BY 1, 2")
on_words("noise_token", "SELECT job_id, page, word_id, k = 7 AS noise FROM words")
on_words("bbox_distance", "SELECT job_id, page, word_id, greatest(0, greatest(x0, 100) - least(x1, 150), greatest(y0, 200) - least(y1, 260)) AS away FROM words WHERE conf = 0.1")
on_words("words_inside", "SELECT job_id, page, word_id FROM words WHERE cx <= 200 AND cy <= 400")
on_words("bbox_extend", "SELECT s.job_id, s.page, s.word_id AS region_id, least(s.x0, coalesce(min(t.x0), s.x0)) AS x0, least(s.y0, coalesce(min(t.y0), s.y0)) AS y0, least(600, greatest(s.x1, coalesce(max(t.x1), s.x1))) AS x1, least(820, greatest(s.y1, coalesce(max(t.y1), s.y1))) AS y1 FROM words s LEFT JOIN words t ON t.k = 5 AND t.job_id = s.job_id AND t.page = s.page AND greatest(s.y0, t.y0) - least(s.y1, t.y1) <= 40 WHERE s.k = 6 GROUP BY s.job_id, s.page, s.word_id, s.x0, s.y0, s.x1, s.y1")

# --- state machines
expect("s_auto_submit", f"SELECT id, 'SUBMITTED' AS status, true AS auto_submitted FROM ({EXPIRED.format('1998-01-01')})")
expect("s_exam_transition", "SELECT id, status AS before, CASE WHEN id % 4 IN (1, 2) AND (id % 4 = 2 OR opens_at <= TIMESTAMP '2001-06-01') THEN if(closes_at <= TIMESTAMP '2001-06-01', 'CLOSED', 'LIVE') ELSE status END AS after FROM exams")
expect("s_violation_state", """, run AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (type = 'TAB_SWITCH') OVER w AS tabs FROM violations WINDOW w AS (PARTITION BY attempt_id ORDER BY server_ts, id)),
  ends AS (SELECT attempt_id, min(n) AS stop FROM run WHERE n >= 5 OR (type = 'TAB_SWITCH' AND tabs >= 3) GROUP BY 1)
  SELECT r.id, r.attempt_id, r.n, r.tabs, CASE WHEN r.n >= 10 THEN 'AUTO_SUBMIT' WHEN type = 'TAB_SWITCH' AND tabs >= 3 THEN 'AUTO_SUBMIT' WHEN r.n >= 5 THEN 'FLAG' ELSE 'NONE' END AS action FROM run r LEFT JOIN ends e USING (attempt_id) WHERE r.n <= coalesce(e.stop, r.n)""")
expect("s_answer_upsert", "SELECT attempt_id, question_id, max(saved_at) AS saved_at, arg_max(time_spent, (saved_at, line_no, time_spent)) FILTER (line_no <> 3) AS time_spent, arg_max(is_correct, (saved_at, line_no, coalesce(if(line_no = 3, NULL, time_spent), -1))) FILTER (is_correct IS NOT NULL) AS is_correct, count(*) AS writes FROM answers GROUP BY 1, 2")
expect("s_heartbeat", "SELECT a.id, CAST(greatest(0, e.duration_seconds - a.id % 8000) AS BIGINT) AS server_left, CAST(least(greatest(0, e.duration_seconds - a.id % 8000), if(a.id % 3 = 0, a.id % 1000, 999999)) AS BIGINT) AS stored, e.duration_seconds <= a.id % 8000 AS auto_submit FROM attempts a JOIN exams e ON e.id = a.exam_id WHERE a.status = 'IN_PROGRESS'")
expect("s_analytics_job", f"SELECT question_id, total, correct FROM {QS} WHERE question_id IN (SELECT question_id FROM answers WHERE attempt_id IN (SELECT id FROM attempts WHERE status = 'GRADED' AND exam_id = 6))")
expect("s_outbox_dispatch", "SELECT event_id AS id, CAST(user_id % 6 + if(event_id % 4 = 0, 1, 0) AS INTEGER) AS attempt_count, event_id % 4 <> 0 AS sent, event_id % 4 = 0 AND user_id % 6 = 4 AS failed FROM events WHERE event_type IN ('click', 'error') AND value <= 20 AND value >= 1 AND user_id % 6 < 5 ORDER BY ts, event_id LIMIT 100")
expect("s_tick_dedupe", "SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 30 AS bucket, count(*) AS n FROM events GROUP BY 1")
expect("s_stuck_uploads", "SELECT doc_id AS id, 'FAILED' AS status FROM documents WHERE doc_id % 5 = 2 AND TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_seconds(n_chars % 600) < TIMESTAMP '2024-01-01 07:55:00'")
expect("s_callback_idempotent", "SELECT DISTINCT doc_id % 300 AS job_id FROM documents WHERE doc_id % 300 NOT IN (SELECT job_id FROM drafts WHERE status = 'APPROVED')")
expect("s_progress_merge", "SELECT user_id AS job_id, arg_max(if(event_type = 'error', 'TAB_SWITCH', upper(event_type)), (ts, event_id)) FILTER (event_id % 2 = 0) AS stage, arg_max(event_id % 50, (ts, event_id)) FILTER (event_id % 3 = 0) AS processed, count(*) AS patches FROM events GROUP BY 1")
expect("s_rate_limit", "SELECT type, CAST(epoch(date_trunc('second', server_ts)) AS BIGINT) // 3600 AS bucket, count(*) AS n, greatest(0, count(*) - 2) AS over FROM violations GROUP BY 1, 2")

# --- routing and calibration
on_words("word_stats", "SELECT job_id, page, count(*) AS words, median(conf * 100) AS median, count(*) FILTER (conf * 100 < 60)::DOUBLE / count(*) AS low_ratio FROM words GROUP BY 1, 2")
FILES = """, files AS (SELECT id, CASE id % 7 WHEN 0 THEN 'x' WHEN 1 THEN text || ' §§§ ¶¶ ~~ §§§' WHEN 2 THEN repeat('xzrt bcdf aaab ', 9) ELSE repeat(text || ' ', 6) END AS text, id % 50 = 0 AS sentinel, id % 9 = 0 AS hint, id % 12 AS words, (id % 10) * 10.0 AS median, (id % 6)::DOUBLE / 6 AS low_ratio, (id % 11)::DOUBLE / 10 AS confidence,
  CASE WHEN id % 4 = 3 OR id % 5 = 0 THEN 'INCONCLUSIVE' WHEN id % 8 * 30 >= 100 THEN 'MACHINE_TEXT' WHEN id % 8 * 30 < 10 THEN 'SCAN_LIKELY' ELSE 'INCONCLUSIVE' END AS verdict FROM drafts),
signs AS (SELECT *, length(text)::DOUBLE AS chars, sentinel OR length(text) < 15 AS near_empty, CASE id % 7 WHEN 1 THEN 10.0::DOUBLE / length(replace(text, ' ', '')) ELSE 0 END AS noise FROM files),
tokens AS (SELECT id, count(*) AS n, count(*) FILTER (NOT regexp_matches(w, '[aeiou]') OR regexp_matches(w, 'aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz')) AS bad FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM files) GROUP BY 1),
votes AS (SELECT s.*, coalesce(bad::DOUBLE / n, 0) AS nondict, if(confidence < 0.7, 0.3::DOUBLE, 0) + if(low_ratio > 0.35, 0.2::DOUBLE, 0) + if(median < 65, 0.15::DOUBLE, 0) + if(chars < 80, 0.15::DOUBLE, 0) + if(noise > 0.25, 0.1::DOUBLE, 0) + if(coalesce(bad::DOUBLE / n, 0) > 0.55, 0.1::DOUBLE, 0) + if(hint, 0.1::DOUBLE, 0) + if(verdict = 'SCAN_LIKELY', 0.1::DOUBLE, 0) AS v FROM signs s LEFT JOIN tokens USING (id)),
reasons AS (SELECT *, CASE WHEN verdict = 'MACHINE_TEXT' THEN 'machine_text_force_node' WHEN near_empty THEN 'near_empty' WHEN words < 8 THEN if(confidence < 0.7, 'low', 'high') || '_confidence_small_sample' WHEN v >= 0.5 THEN 'score_threshold' ELSE 'below_threshold' END AS reason FROM votes),
decided AS (SELECT id, reason, verdict, reason IN ('near_empty', 'low_confidence_small_sample', 'score_threshold') AS route, CASE WHEN reason IN ('score_threshold', 'below_threshold') THEN least(1, floor(v * 100 + 0.5) / 100) ELSE (reason IN ('near_empty', 'low_confidence_small_sample'))::INTEGER::DOUBLE END AS score FROM reasons)"""


def on_files(name, body):
    expect(name, f"{FILES} {body}")


on_files("alpha_noise", f"SELECT id, {r('noise', 6)} AS noise FROM signs")
on_files("nondict_ratio", f"SELECT id, {r('nondict', 6)} AS nondict FROM votes")
on_files("pre_route", "SELECT id, hint, verdict FROM files")
on_files("route_signal", "SELECT id, chars AS chars_per_page, near_empty FROM signs")
on_files("route_decide", "SELECT id, route, score, reason FROM decided")
on_files("route_predict", "SELECT id, CASE WHEN reason = 'machine_text_force_node' THEN false WHEN reason = 'near_empty' THEN true WHEN reason LIKE '%small_sample' THEN route ELSE score >= 0.35 END AS routed FROM decided")
on_files("routing_summary", "SELECT 'reason' AS kind, reason AS value, count(*) AS n FROM decided GROUP BY 2 UNION ALL SELECT 'verdict', verdict, count(*) FROM decided GROUP BY 2 UNION ALL SELECT 'routed', if(route, 'routed', 'kept'), count(*) FROM decided GROUP BY 2 UNION ALL SELECT 'bucket', b::VARCHAR, count(d.id) FROM range(5) t(b) LEFT JOIN decided d ON least(4, floor(d.score * 5)) = b GROUP BY 2")
on_files("routing_counters", f"SELECT count(*) AS total, count(*) FILTER (route) AS routed, {r('count(*) FILTER (route)::DOUBLE / count(*)', 3)} AS route_rate FROM decided")
expect("log_source", """SELECT id % 2 = 0 AS "wouldRoute", 'near_empty' AS reason, count(*) AS n, count(DISTINCT text) AS files FROM drafts WHERE id % 3 = 0 GROUP BY 1""")
SWEEP = f"""{FILES}, c AS (SELECT k / 20 AS threshold, count(*) FILTER (said AND h) AS tp, count(*) FILTER (said AND NOT h) AS fp, count(*) FILTER (NOT said AND NOT h) AS tn, count(*) FILTER (NOT said AND h) AS fn FROM (SELECT k, id % 4 < 2 AS h, CASE WHEN reason = 'machine_text_force_node' THEN false WHEN reason = 'near_empty' THEN true WHEN reason LIKE '%small_sample' THEN route ELSE score >= k / 20 END AS said FROM decided, range(21) t(k) WHERE id % 3 <> 0) GROUP BY k),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM c),
s AS (SELECT threshold, tp, fp, tn, fn, {r('p', 3)} AS precision, {r('rc', 3)} AS recall, {r('coalesce(2 * p * rc / nullif(p + rc, 0), 0)', 3)} AS f1, {r('(tp + tn) / (tp + fp + tn + fn)', 3)} AS accuracy FROM pr)"""
expect("threshold_sweep", f"{SWEEP} SELECT * FROM s")
expect("threshold_pick", f"{SWEEP} SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1")
expect("threshold_pick_precise", f"{SWEEP} SELECT threshold, precision, recall FROM s WHERE precision >= 0.3 ORDER BY recall DESC, threshold LIMIT 1")

# --- authoring
expect("validate_question", """SELECT id, CASE WHEN id % 11 = 0 THEN 'payload is no JSON' WHEN type = 'TRUE_FALSE' AND id % 3 = 0 THEN 'correct must be a boolean' WHEN type = 'FILL_BLANK' AND id % 3 = 0 THEN 'accepted must hold a text' WHEN type = 'FILL_BLANK' AND id % 3 = 1 THEN 'caseSensitive must be a boolean'
  WHEN type = 'MATCH_FOLLOWING' AND id % 3 = 0 THEN 'two pairs at least' WHEN type = 'MATRIX_MATCH' AND id % 3 = 0 THEN 'rows and cols must hold a text' WHEN type = 'MATRIX_MATCH' AND id % 3 = 1 THEN 'correctMap must be an object' WHEN type = 'DESCRIPTIVE' AND id % 3 = 0 THEN 'maxWords out of range'
  WHEN type = 'VISUAL' AND id % 3 = 0 THEN 'content is missing' WHEN type = 'VISUAL' AND id % 3 = 1 THEN 'optionCount out of range' WHEN type = 'VISUAL' AND size % 5 < 2 THEN '2 to 6 options' WHEN type = 'VISUAL' AND size % 3 <> 1 THEN 'exactly one right option'
  WHEN type LIKE '%CHOICE' AND size % 5 < 2 THEN 'two options at least' WHEN type = 'SINGLE_CHOICE' AND size % 3 <> 1 THEN 'exactly one right option' WHEN type = 'MULTIPLE_CHOICE' AND size % 3 < 1 THEN 'a right option at least' WHEN type NOT LIKE '%CHOICE' AND type <> 'VISUAL' AND size % 5 > 0 THEN 'no options allowed' END AS error FROM questions""")
expect("taxonomy_chain", """SELECT d.id, CASE WHEN d.p > 4 THEN 'unknown program' WHEN d.s > 24 THEN 'unknown subject' WHEN n_regionkey <> d.p THEN 'subject of another program' WHEN d.c IS NOT NULL AND s_suppkey IS NULL THEN 'unknown chapter' WHEN s_nationkey <> d.s THEN 'chapter of another subject' WHEN d.t IS NOT NULL AND c_custkey IS NULL THEN 'unknown topic' WHEN c_custkey % 50 <> d.c THEN 'topic of another chapter' END AS error
  FROM (SELECT o_orderkey AS id, o_orderkey % 6 AS p, if(o_orderkey % 5 = 0, NULL, o_orderkey % 27) AS s, if(o_orderkey % 7 = 0, NULL, o_orderkey % 12) AS c, if(o_orderkey % 3 = 0, NULL, o_orderkey % 160) AS t FROM orders) d LEFT JOIN nation ON n_nationkey = d.s LEFT JOIN supplier ON s_suppkey = d.c LEFT JOIN customer ON c_custkey = d.t""")
expect("publish_gate", f"""SELECT id, error, CASE WHEN error IS NULL THEN if(opens_at <= TIMESTAMP '1996-06-01', 'LIVE', 'SCHEDULED') END AS status FROM (SELECT e.*, CASE WHEN id % 7 <> 1 THEN 'not the author' WHEN id % 3 = 0 THEN 'a paper' WHEN id % 4 <> 0 THEN 'not a draft' WHEN id = 4 OR id NOT IN (SELECT exam_id FROM exam_questions) THEN 'no questions'
  WHEN id = 16 OR id NOT IN (SELECT exam_id FROM assignments) THEN 'no assignments' WHEN closes_at <= opens_at THEN 'closes before it opens' WHEN id % 5 = 0 OR id NOT IN (SELECT exam_id FROM {ASSIGNED}) THEN 'no students' END AS error FROM exams e)""")
expect("shift_numbers", "SELECT id, CAST(q AS INTEGER) AS question_number, row_number() OVER (ORDER BY q NULLS LAST, position, id) - 1 AS position FROM (SELECT id, position, if(question_number >= 40, question_number + 1, question_number) AS q FROM drafts WHERE job_id = 3 UNION ALL SELECT -1, 0, 40)")
expect("move_number", """, m AS (SELECT max(question_number) FILTER (id = 603) AS was, count(*) FILTER (question_number = 25 AND id <> 603) > 0 AS taken FROM drafts WHERE job_id = 3),
  n AS (SELECT d.id, d.position, CASE WHEN was IS NULL AND taken THEN question_number WHEN d.id = 603 THEN 25 WHEN question_number BETWEEN 25 AND was - 1 THEN question_number + 1 WHEN question_number BETWEEN was + 1 AND 25 THEN question_number - 1 ELSE question_number END AS q FROM drafts d, m WHERE job_id = 3)
  SELECT id, CAST(q AS INTEGER) AS question_number, row_number() OVER (ORDER BY q NULLS LAST, position, id) - 1 AS position FROM n""")
expect("clone_exam", "SELECT 1008::BIGINT AS exam_id, question_id, question_id AS position FROM exam_questions WHERE exam_id = 8")
expect("clone_paper", "SELECT CAST(n_nationkey + 1000 AS BIGINT) AS id, n_name || ' (copy)' AS title, 'DRAFT' AS status, CAST(n_nationkey AS BIGINT) AS source_id FROM nation WHERE n_nationkey < 3")
expect("exam_from_paper", "SELECT 900::BIGINT AS exam_id, p_partkey AS question_id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS position, CAST(1 + p_size % 5 AS DECIMAL(5,2)) AS marks, 0.25::DECIMAL(5,2) AS negative_marks FROM part WHERE p_partkey % 20 = 4")
expect("denorm_names", "SELECT o_orderkey AS id, coalesce(n_name, if(o_custkey % 3 = 0, 'S' || (o_custkey % 10), NULL)) AS subject, if(s_suppkey IS NULL, NULL, 'Class ' || (s_suppkey % 12)) AS chapter FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30 LEFT JOIN supplier ON s_suppkey = o_orderkey % 14")
expect("batch_order", """SELECT CAST(doc_id % 20 AS BIGINT) AS batch_id, doc_id AS id, NULL::INTEGER AS batch_order, 'a file that isn''t pending' AS error FROM documents WHERE doc_id % 20 = 11 UNION ALL SELECT 0, doc_id, CAST(doc_id // 20 AS INTEGER), NULL FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT 5, doc_id, NULL, 'a file twice' FROM documents WHERE doc_id % 20 = 5 UNION ALL SELECT 5, 25, NULL, 'a file twice'""")
expect("draft_state", "SELECT id, a AS action, CASE WHEN a = 'edit' AND status NOT IN ('APPROVED', 'DISCARDED') THEN 'EDITED' WHEN a = 'discard' AND status <> 'APPROVED' THEN 'DISCARDED' WHEN a = 'revert' AND status = 'APPROVED' THEN 'EDITED' END AS after FROM drafts, (VALUES ('edit'), ('discard'), ('revert')) v(a)")
expect("upload_state", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN if(doc_id % 3 = 0, 'UPLOADED', 'PROCESSING') END AS after FROM documents")
expect("classroom_unique", "SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM classrooms WINDOW w AS (PARTITION BY branch_id % 2, name, year, section) QUALIFY count(*) OVER w > 1")
expect("user_list", "SELECT id, name, count(*) OVER () AS total FROM students WHERE class_label = 'BUILDING' AND branch_id = 2 ORDER BY name, id LIMIT 50")
expect("branch_list", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 6 <> 5")
expect("soft_delete", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 5 THEN TIMESTAMP '2024-01-01' WHEN n_nationkey < 8 THEN TIMESTAMP '2025-05-05' END AS deleted_at FROM nation")
expect("bulk_patch", "SELECT id, if(id % 20 = 0, 'EDITED', status) AS status, if(id % 30 = 0, 'S9', assigned_subject) AS assigned_subject FROM drafts")
expect("bulk_result", "SELECT id, error IS NULL AS ok, error FROM (SELECT id, CASE WHEN status = 'APPROVED' THEN 'already approved' WHEN status = 'DISCARDED' THEN 'discarded' WHEN id % 4 <> 0 AND assigned_subject IS NULL THEN 'no subject' END AS error FROM drafts)")
expect("json_ingest", "SELECT event_id AS id, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE props->>'k' IS NOT NULL AND event_id NOT IN (SELECT id FROM drafts WHERE status = 'APPROVED')")
expect("rows_sink", f"SELECT exam_id, count(*) AS n FROM (SELECT exam_id, student_id FROM attempts UNION ALL (SELECT exam_id, student_id FROM {ASSIGNED} EXCEPT SELECT exam_id, student_id FROM attempts)) GROUP BY 1")
expect("upsert_sink", "SELECT if(p_partkey % 4 = 0, 'NEW', p_brand) AS topic, count(*) AS n FROM part GROUP BY 1")

# --- drafts of regions, stitched over pages; every page of a job has words, so the page before is the one read before
STITCHED = f""", many AS (SELECT job_id, page, CAST(count(DISTINCT col) AS INTEGER) AS n_cols, min(col) AS first_col FROM kept GROUP BY 1, 2),
regs AS (SELECT job_id, page, CAST(col AS INTEGER) AS col, place, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, n_cols FROM boxes JOIN many USING (job_id, page) WHERE y1 - y0 >= 12 AND x1 - x0 >= 12
  UNION ALL SELECT DISTINCT job_id, page, 0, 0, 0, 0, 600, 820, 0 FROM words WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.job_id = words.job_id AND k.page = words.page)),
ends AS (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY col DESC, y0 DESC, place DESC) = 1 AS last FROM regs),
inw AS (SELECT e.job_id, e.page, e.col, e.place, e.n_cols, w.word_id, w.text, w.k, w.x0, w.x1, w.y0, w.k IN (2, 3, 4) OR (w.k = 1 AND e.n_cols = 0) AS label FROM ends e JOIN words w ON w.job_id = e.job_id AND w.page = e.page AND w.cx >= e.x0 AND w.cx < e.x1 AND w.cy >= e.y0 AND w.cy < e.y1),
tops_in AS (SELECT *, min(y0) FILTER (label) OVER (PARTITION BY job_id, page, col, place) AS top FROM inw),
told AS (SELECT job_id, page, col, place, any_value(n_cols) AS n_cols, CAST(count(*) AS INTEGER) AS words, string_agg(text, ' ' ORDER BY word_id) AS text,
    count(*) FILTER (k IN (5, 6) AND (top IS NULL OR y0 < top - 1)) >= 2 OR coalesce(sum(length(text)) FILTER (k IN (5, 6) AND (top IS NULL OR y0 < top - 1)), 0) >= 8 AS stem,
    CASE WHEN {TF} THEN 'TRUE_FALSE' WHEN count(DISTINCT text) FILTER (k = 2) + count(DISTINCT text) FILTER (k = 3) + count(DISTINCT text) FILTER (k = 1 AND n_cols = 0) >= 2 THEN 'MCQ' WHEN bool_or(k = 6) THEN 'DIAGRAM_BASED' ELSE 'UNKNOWN' END AS kind,
    count(DISTINCT lower(regexp_replace(text, '[().]', '', 'g'))) FILTER (k IN (2, 3)) AS found FROM tops_in GROUP BY ALL),
firsts AS (SELECT job_id, page, col, place, min_by(CAST(replace(text, '.', '') AS INTEGER), (y0, x0, word_id)) AS num FROM inw w WHERE k = 1 AND n_cols > 0 AND NOT EXISTS (SELECT 1 FROM inw o WHERE o.job_id = w.job_id AND o.page = w.page AND o.col = w.col AND o.place = w.place AND o.y0 = w.y0 AND o.word_id <> w.word_id AND o.x1 <= w.x0 AND w.x0 - o.x1 < 24) GROUP BY 1, 2, 3, 4),
sure0 AS (SELECT e.*, t.words, t.text, t.stem, t.kind, f.num, if(found BETWEEN 2 AND 6, found, 4)::INTEGER AS options, e.n_cols > 0 AND f.num IS NULL AND NOT t.stem AS invalid,
    1::DOUBLE - if(t.words < 5, 0.25, 0)::DOUBLE - if(e.y0 > 697, 0.2, 0)::DOUBLE - if(last AND e.y1 >= 818, 0.2, 0)::DOUBLE AS c FROM ends e JOIN told t USING (job_id, page, col, place) LEFT JOIN firsts f USING (job_id, page, col, place)),
sure AS (SELECT * REPLACE (if(invalid, least(c, 0.3), c)::DOUBLE AS c) FROM (SELECT * REPLACE (if(kind = 'MCQ' AND NOT stem, greatest(0.1, c - 0.3::DOUBLE), c)::DOUBLE AS c) FROM (SELECT * REPLACE (if(kind = 'UNKNOWN', greatest(0.1, c - 0.2::DOUBLE), c)::DOUBLE AS c) FROM sure0))),
placed_in AS (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY col, y0, place) - 1 AS idx, row_number() OVER (PARTITION BY job_id ORDER BY page, col, y0, place) - 1 AS position FROM sure),
tips AS (SELECT job_id, page, min(k.y0) AS top, any_value(lft) AS lft, any_value(rgt) AS rgt FROM kept k JOIN many USING (job_id, page) JOIN lefts l USING (job_id, page, col) WHERE k.col = first_col GROUP BY 1, 2),
steps AS (SELECT job_id, page, lag(open_idx) OVER j AS open_in, lag(page) OVER j AS from_page, floor(top - 4.8 + 0.5)::DOUBLE AS hy, greatest(0, floor(lft - 4.8 + 0.5))::DOUBLE AS hx0, least(600, floor(rgt + 0.5))::DOUBLE AS hx1
  FROM (SELECT DISTINCT job_id, page FROM words) LEFT JOIN (SELECT job_id, page, max(idx) FILTER (last AND y1 >= 818 AND n_cols > 0) AS open_idx FROM placed_in GROUP BY 1, 2) USING (job_id, page) LEFT JOIN tips USING (job_id, page) WINDOW j AS (PARTITION BY job_id ORDER BY page)),
stitched AS (SELECT p.job_id, p.page, p.col, p.n_cols, CAST(p.position AS INTEGER) AS position, p.num AS question_number, p.kind, p.options, if(s.page IS NULL, p.c, least(p.c, 0.55))::DOUBLE AS c, p.invalid AS invalid_crop, s.page IS NOT NULL OR p.c < 0.6 OR p.invalid AS needs_review, p.text, p.words, p.x0, p.y0, p.x1, p.y1,
    s.page AS span_page_end, s.hx0 AS header_x0, s.hx1 AS header_x1, s.hy AS header_y1
  FROM placed_in p LEFT JOIN steps s ON s.job_id = p.job_id AND s.from_page = p.page AND s.open_in = p.idx AND s.hy >= 12)"""
on_words("draft_stitch", f"{STITCHED} SELECT job_id, page, col, position, question_number, kind, options, {r('c', 2)} AS confidence, invalid_crop, needs_review, words, span_page_end, header_x0, header_x1, header_y1 FROM stitched")
on_words("missing_trace", f"""{STITCHED}, have AS (SELECT DISTINCT job_id, question_number AS n FROM stitched WHERE NOT invalid_crop AND question_number IS NOT NULL),
lost AS (SELECT j.job_id, CAST(g AS INTEGER) AS num, (SELECT max(n) FROM have h WHERE h.job_id = j.job_id AND n < g) AS previous, (SELECT min(n) FROM have h WHERE h.job_id = j.job_id AND n > g) AS next FROM (SELECT DISTINCT job_id FROM stitched) j CROSS JOIN range(1, 63) t(g) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.job_id = j.job_id AND h.n = g)),
seen AS (SELECT l.job_id, l.num, min_by({{'page': w.page, 'x': w.x0, 'y': w.y0}}, (w.page, w.word_id)) AS a FROM lost l JOIN words w ON w.job_id = l.job_id AND w.k = 1 AND w.text = l.num || '.' GROUP BY 1, 2),
hosts AS (SELECT s.job_id, s.num, min_by({{'num': d.question_number, 'col': d.col, 'n': d.n_cols}}, d.position) AS d FROM seen s JOIN stitched d ON d.job_id = s.job_id AND d.page = s.a.page AND s.a.x >= d.x0 - 2 AND s.a.x < d.x1 + 2 AND s.a.y >= d.y0 - 2 AND s.a.y < d.y1 + 2 GROUP BY 1, 2),
near AS (SELECT job_id, question_number AS n, min_by({{'page': page, 'col': col, 'n': n_cols}}, position) AS d FROM stitched WHERE NOT invalid_crop AND question_number IS NOT NULL GROUP BY 1, 2),
labelled AS (SELECT l.job_id, l.num AS expected, l.previous, l.next, coalesce(s.a.page, r.d.page) AS page, if(h.d IS NULL, r.d.col, h.d.col) AS col, if(h.d IS NULL, r.d.n, h.d.n) AS n, s.a IS NOT NULL AS ocr_detected, EXISTS (SELECT 1 FROM numbers x WHERE x.job_id = l.job_id AND x.num = l.num) AS marker_detected, EXISTS (SELECT 1 FROM kept x WHERE x.job_id = l.job_id AND x.num = l.num) AS stays, h.d.num AS merged_into
  FROM lost l LEFT JOIN seen s USING (job_id, num) LEFT JOIN hosts h USING (job_id, num) LEFT JOIN near r ON r.job_id = l.job_id AND r.n = coalesce(l.previous, l.next))
SELECT job_id, expected, previous, next, page, CASE WHEN col IS NULL THEN NULL WHEN n <= 1 THEN 'Single' WHEN col = 0 THEN 'Left' WHEN col = 1 AND n = 2 THEN 'Right' ELSE 'Col ' || (col + 1) END AS column, ocr_detected, marker_detected, marker_detected AND NOT stays AS removed_in_sequence, merged_into,
  CASE WHEN NOT ocr_detected THEN 'OCR_MISS' WHEN NOT marker_detected THEN 'MARKER_MISS' WHEN NOT stays THEN 'SEQUENCE_REMOVED' WHEN merged_into IS NOT NULL THEN 'NOT_SPLIT' ELSE 'UNKNOWN' END AS stage FROM labelled""")
on_words("crowded_crops", f"""{STITCHED} SELECT job_id, position, array_to_string(ns, ',') AS numbers FROM (SELECT job_id, position, list_sort(list_distinct(list_transform(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[0-9]+[.]$')), lambda w: CAST(replace(w, '.', '') AS INTEGER)))) AS ns FROM stitched WHERE NOT invalid_crop) WHERE len(ns) >= 2""")
on_words("review_counts", f"{STITCHED} SELECT job_id, coalesce(string_agg(position, ',' ORDER BY position) FILTER (NOT invalid_crop AND question_number IS NULL), '') AS numberless, count(*) FILTER (needs_review) AS needs_review FROM stitched GROUP BY 1")
on_words("garbage_clusters", """, bad AS (SELECT job_id, page, word_id, x0, y0, x1, y1 FROM words WHERE conf < 0.15 OR k = 7),
reach AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT job_id, page, word_id, word_id AS other FROM bad
  UNION SELECT r.job_id, r.page, r.word_id, o.word_id FROM r JOIN bad b ON b.job_id = r.job_id AND b.page = r.page AND b.word_id = r.other JOIN bad o ON o.job_id = r.job_id AND o.page = r.page AND greatest(b.x0, o.x0) - least(b.x1, o.x1) <= 20 AND greatest(b.y0, o.y0) - least(b.y1, o.y1) <= 20) SELECT * FROM r))
SELECT job_id, page, cluster, count(*) AS n, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM bad JOIN (SELECT job_id, page, word_id, min(other) AS cluster FROM reach GROUP BY 1, 2, 3) USING (job_id, page, word_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")

# --- signed callbacks; the padded keys are those of the shared secret
INNER, OUTER = (bytes(k ^ x for k in b"a shared secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
CALLS = """, calls AS (SELECT doc_id AS call_id, doc_id % 400 AS job, regexp_extract(text, '^[\\p{L}]*') AS word,
    '{"ocrJobId":' || (doc_id % 400) || ',"overallConfidence":0.5,"drafts":[{"position":0,"text":"' || word || '","optionCount":4,"options":[{"label":"' || word || '"},{"label":"x","isCorrect":true}],"figures":[{"storageKey":"f/' || doc_id || '","kind":"DIAGRAM","boundingBox":{"x0":1,"y0":2,"x1":3,"y1":4}}]},{"position":1,"text":"next"}]' || if(doc_id % 13 = 0, ',"errorMessage":"unreadable"', '') || if(doc_id % 17 = 0, '', '}') AS body FROM documents),
signed AS (SELECT *, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(body)))) AS sign FROM calls),
told AS (SELECT *, CASE WHEN call_id % 11 = 0 THEN 'unsigned' WHEN call_id % 7 = 0 THEN 'forged' WHEN call_id % 17 = 0 THEN 'malformed' WHEN job >= 300 THEN 'unknown' WHEN call_id % 13 = 0 THEN 'failed' WHEN job % 5 = 3 OR job % 9 = 0 THEN 'done' ELSE 'written' END AS first_outcome FROM signed),
ended AS (SELECT *, if(first_outcome = 'written' AND call_id > min(call_id) FILTER (first_outcome = 'written') OVER (PARTITION BY job), 'done', first_outcome) AS outcome FROM told)""".replace("{OUTER}", OUTER).replace("{INNER}", INNER)
expect("callback_outcomes", f"{CALLS} SELECT call_id, if(call_id % 11 = 0, NULL, if(call_id % 7 = 0, reverse(sign), sign)) AS signature, outcome FROM ended")
expect("callback_drafts", f"{CALLS} SELECT job AS job_id, 0 AS position, word AS text, 4 AS option_count, 2 AS options, true AS keyed, 1 AS figures FROM ended WHERE outcome = 'written' UNION ALL SELECT job, 1, 'next', NULL, NULL, NULL, 0 FROM ended WHERE outcome = 'written'")
expect("callback_figures", f"{CALLS} SELECT job AS job_id, 0 AS position, 0 AS figure_index, 'f/' || call_id AS storage_key, 'DIAGRAM' AS kind, CAST(NULL AS VARCHAR) AS caption, 4::DOUBLE AS y1 FROM ended WHERE outcome = 'written'")
expect("callback_jobs", f"{CALLS} SELECT job AS job_id, if(o = 'written', 'COMPLETED', 'FAILED') AS stage, if(o = 'written', 'READY_FOR_REVIEW', 'FAILED') AS status, if(o = 'written', NULL, 'unreadable') AS error, if(o = 'written', 2, 0) AS drafts, if(o = 'written', 0.5::DOUBLE, NULL) AS confidence FROM (SELECT job, max_by(outcome, call_id) AS o FROM ended WHERE outcome IN ('written', 'failed') GROUP BY 1)")

# --- pages of one column, forty numbered questions a page
NUMBERED = ", numbered AS (SELECT p_partkey AS id, p_partkey // 40 AS job_id, 1 AS page, p_partkey % 40 AS idx, 101 + p_partkey % 40 AS num FROM part), around AS (SELECT *, lag(idx) OVER j IS NOT NULL AND lead(idx) OVER j IS NOT NULL AS between FROM numbered WINDOW j AS (PARTITION BY job_id ORDER BY idx))"
expect("recover_truncated", f"{NUMBERED} SELECT job_id, page, id * 10 AS word_id, CAST(num AS INTEGER) AS num FROM around WHERE job_id % 2 = 0 AND idx % 10 = 3 AND between")
expect("recover_century", f"{NUMBERED} SELECT job_id, page, id * 10 AS word_id, CAST(num AS INTEGER) AS num FROM numbered n WHERE job_id % 2 = 1 AND idx % 10 = 7 AND EXISTS (SELECT 1 FROM numbered m WHERE m.job_id = n.job_id AND m.idx > n.idx)")
PIECES = "SELECT job_id, page, CAST(row_number() OVER j - 1 AS INTEGER) AS place, if(row_number() OVER j = 1, 0, idx * 40 - 5)::DOUBLE AS y0, coalesce(lead(idx) OVER j * 40 - 5, 2000)::DOUBLE AS y1 FROM numbered"
expect("split_internal", f"{NUMBERED} {PIECES} WINDOW j AS (PARTITION BY job_id ORDER BY idx)")
expect("recover_gaps", f"{NUMBERED} {PIECES} WHERE idx % 7 <> 3 OR idx = 0 OR id = 1 WINDOW j AS (PARTITION BY job_id ORDER BY idx)")
expect("merge_incomplete", f"{NUMBERED} SELECT job_id, page, CAST(dense_rank() OVER (PARTITION BY job_id ORDER BY idx // 3) - 1 AS INTEGER) AS place, min(idx) * 40 - 5::DOUBLE AS y0, max(idx) * 40 + 35::DOUBLE AS y1, CAST(3 * count(*) + 2 * count(*) FILTER (idx % 3 = 2) AS INTEGER) AS words FROM numbered GROUP BY job_id, page, idx // 3")
