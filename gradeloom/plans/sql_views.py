"""The assessment tables in DuckDB's SQL, written apart from the adapter: what expected rows are computed from."""

VIEWS = """WITH answers AS (
  SELECT l_orderkey AS attempt_id, l_partkey AS question_id, l_linenumber AS line_no, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_correct, CAST(l_quantity AS BIGINT) AS time_spent, l_shipdate AS saved_at FROM lineitem),
attempts AS (
  SELECT o_orderkey AS id, o_custkey AS student_id, o_orderkey % 50 AS exam_id,
    CASE o_orderstatus WHEN 'F' THEN if(o_orderpriority = '1-URGENT', 'FLAGGED', 'GRADED') WHEN 'P' THEN 'SUBMITTED' ELSE if(o_orderpriority = '5-LOW', 'NOT_STARTED', 'IN_PROGRESS') END AS status,
    if(o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT', CAST(o_totalprice AS DECIMAL(12,2)), NULL) AS score, o_orderdate AS started_at,
    if(o_orderstatus = 'O', NULL, o_orderdate + to_seconds(o_orderkey % 5000)) AS submitted_at FROM orders),
exams AS (
  SELECT o_orderkey % 50 AS id, CAST(max(o_totalprice) AS DECIMAL(12,2)) AS total_marks, min(o_orderdate) AS opens_at, max(o_orderdate) AS closes_at, if(id % 3 = 0, 'PAPER', 'TEST') AS kind,
    ['DRAFT','SCHEDULED','LIVE','CLOSED'][id % 4 + 1] AS status, 1800 + 600 * (id % 7) AS duration_seconds, id % 7 AS created_by, id % 25 AS branch_id, 'Exam ' || id AS title FROM orders GROUP BY 1),
questions AS (
  SELECT p_partkey AS id, p_type AS subject, p_brand AS topic, CASE WHEN p_size > 33 THEN 'HARD' WHEN p_size > 16 THEN 'MEDIUM' ELSE 'EASY' END AS difficulty, p_name AS name, p_size AS size,
    ['SINGLE_CHOICE','MULTIPLE_CHOICE','TRUE_FALSE','FILL_BLANK','MATCH_FOLLOWING','MATRIX_MATCH','DESCRIPTIVE','VISUAL'][p_partkey % 8 + 1] AS type,
    CAST(1 + p_size % 5 AS DECIMAL(5,2)) AS marks, CAST(p_size % 3 AS DECIMAL(5,2)) / 4 AS negative_marks, p_size % 10 <> 0 AS is_active FROM part),
exam_questions AS (SELECT DISTINCT l_orderkey % 50 AS exam_id, l_partkey AS question_id, l_partkey AS position FROM lineitem),
students AS (SELECT c_custkey AS id, c_nationkey AS branch_id, c_mktsegment AS class_label, c_name AS name, if(c_acctbal < 0, NULL, 'R' || c_custkey) AS roll_no FROM customer),
branches AS (SELECT n_nationkey AS id, n_regionkey AS tenant_id, n_name AS name, if(n_nationkey % 6 = 5, TIMESTAMP '2024-01-01', NULL) AS deleted_at FROM nation),
classrooms AS (SELECT s_suppkey AS id, 'Class ' || (s_suppkey % 12) AS name, s_nationkey AS branch_id, 2020 + s_suppkey % 5 AS year, chr(CAST(65 + s_suppkey % 4 AS INTEGER)) AS section, if(s_acctbal < 0, NULL, ['Physics','Maths','Biology'][s_suppkey % 3 + 1]) AS subject, s_suppkey % 7 AS created_by FROM supplier),
memberships AS (
  SELECT c_custkey % 10 AS classroom_id, c_custkey AS student_id, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS joined_at FROM customer
  UNION ALL SELECT (c_custkey * 3 + 1) % 10, c_custkey, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 900 + 500 AS INTEGER)) FROM customer WHERE c_custkey % 7 = 0),
assignments AS (SELECT s_suppkey % 50 AS exam_id, s_suppkey % 10 AS classroom_id, NULL AS student_id FROM supplier UNION ALL SELECT c_custkey % 50, NULL, c_custkey FROM customer WHERE c_custkey % 20 = 0),
papers AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, ['DRAFT','PUBLISHED','ARCHIVED'][n_nationkey % 3 + 1] AS status, n_nationkey % 7 AS created_by, n_regionkey AS tenant_id FROM nation),
paper_questions AS (SELECT p_partkey % 20 AS paper_id, p_partkey AS question_id, p_partkey // 20 AS position, CAST(1 + p_size % 5 AS DECIMAL(5,2)) AS marks FROM part),
uploads AS (
  SELECT doc_id AS id, if(doc_id % 10 = 9, NULL, doc_id % 20) AS batch_id, doc_id // 20 AS batch_order, ['PENDING','UPLOADED','PROCESSING','READY','FAILED'][doc_id % 5 + 1] AS status, source || '/' || doc_id AS storage_key, doc_id % 25 AS branch_id,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_seconds(n_chars % 600) AS updated_at FROM documents),
drafts AS (
  SELECT o_orderkey AS id, o_orderkey % 200 AS job_id, o_orderkey // 200 AS position, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE if(o_orderpriority < '3', 'DISCARDED', 'EDITED') END AS status,
    if(o_custkey % 5 = 0, NULL, o_custkey % 180 + 1) AS question_number, o_custkey % 7 AS option_count, o_custkey % 5 AS options_length, (o_orderkey % 300) || '. What is ' || o_orderpriority || '?' AS text,
    if(o_custkey % 3 = 0, 'S' || (o_custkey % 10), NULL) AS assigned_subject, if(o_orderkey % 4 = 0, 'E' || (o_orderkey % 10), NULL) AS explicit_subject FROM orders),
notifications AS (
  SELECT event_id AS id, user_id, if(event_type IN ('click', 'error'), 'EMAIL', 'IN_APP') AS channel, ts AS created_at, if(value > 20, ts + to_seconds(60), NULL) AS sent_at, if(value < 1, ts, NULL) AS failed_at, user_id % 6 AS attempt_count, if(value > 10, ts, NULL) AS read_at FROM events),
violations AS (SELECT event_id AS id, user_id AS attempt_id, if(event_type = 'error', 'TAB_SWITCH', upper(event_type)) AS type, ts AS server_ts FROM events),
topic_counts AS (
  SELECT student_id, subject, topic, count(*) AS total, count(*) FILTER (is_correct) AS correct FROM answers a, attempts t, questions q
  WHERE t.id = a.attempt_id AND q.id = a.question_id AND is_correct IS NOT NULL AND length(subject) > 0 AND length(topic) > 0 GROUP BY ALL),
graded AS (
  SELECT attempt_id, question_id, line_no, time_spent, saved_at, type, marks, negative_marks, line_no IN (6, 7) AS blank,
    CASE type WHEN 'SINGLE_CHOICE' THEN line_no <> 5 AND time_spent % 4 = question_id % 4 WHEN 'VISUAL' THEN line_no <> 5 AND time_spent % 4 = question_id % 4
      WHEN 'MULTIPLE_CHOICE' THEN time_spent % 3 <> 0 AND time_spent % 2 = question_id % 2 WHEN 'TRUE_FALSE' THEN line_no <> 5 AND time_spent % 2 = question_id % 2
      WHEN 'FILL_BLANK' THEN time_spent % 4 = 1 OR (time_spent % 4 IN (0, 3) AND question_id % 3 <> 0) WHEN 'MATCH_FOLLOWING' THEN time_spent % 3 <> 1 WHEN 'MATRIX_MATCH' THEN time_spent % 3 = 0 END AS hit
  FROM answers JOIN questions ON questions.id = question_id),
marked AS (
  SELECT attempt_id, question_id, line_no, time_spent, saved_at, type, marks, blank, CASE WHEN type = 'DESCRIPTIVE' THEN NULL ELSE hit AND NOT blank END AS is_correct,
    CASE WHEN type = 'DESCRIPTIVE' OR blank THEN 0 WHEN hit THEN marks ELSE -negative_marks END AS marks_awarded FROM graded)
"""
