"""Papers, exams, drafts and uploads: checks, summaries and the rows that a change leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.state import at


def first_error(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule whose condition holds; null where none does."""
    c = F.when(rules[0][0], rules[0][1])
    for condition, message in rules[1:]:
        c = c.when(condition, message)
    return c


def drafts_by_status(drafts: DataFrame, job: int | None = None, states: tuple = ("PENDING", "EDITED", "APPROVED", "DISCARDED")) -> DataFrame:
    """(status, n) of a job's drafts, every state counted."""
    rows = drafts if job is None else drafts.where(F.col("job_id") == job)
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states]).unpivot([], list(states), "status", "n")


def finalised_jobs(drafts: DataFrame) -> DataFrame:
    """(job_id, finalised): all its drafts are approved or discarded."""
    return drafts.groupBy("job_id").agg(F.bool_and(F.col("status").isin("APPROVED", "DISCARDED")).alias("finalised"))


def upload_state(status: Column) -> Column:
    """How an upload shows in a batch's progress."""
    return F.when(status == "READY", "COMPLETED").when(status == "FAILED", "FAILED").when(status == "PROCESSING", "PROCESSING").otherwise("QUEUED")


def batch_progress(uploads: DataFrame) -> DataFrame:
    """Per batch: uploads in each state, and the one that is current: the first in processing, else the first in the queue."""
    u = uploads.where("batch_id IS NOT NULL").withColumn("state", upload_state(F.col("status")))
    first = lambda s: F.min(F.when(F.col("state") == s, F.struct("batch_order", "id")))["id"]
    return u.groupBy("batch_id").agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("QUEUED", "PROCESSING", "COMPLETED", "FAILED")], F.coalesce(first("PROCESSING"), first("QUEUED")).alias("current_id"))


def batch_list(uploads: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per batch: files, drafts of all of them, completed, failed, whether any is in processing, the first upload."""
    n = drafts.groupBy(F.col("job_id").alias("__j")).agg(F.count("*").alias("d"))
    u = uploads.where("batch_id IS NOT NULL").join(n, F.col("id") == F.col("__j"), "left")
    is_ = lambda s: F.col("status") == s
    return u.groupBy("batch_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("d"), F.lit(0)).alias("drafts"), F.count_if(is_("READY")).alias("completed"), F.count_if(is_("FAILED")).alias("failed"), F.bool_or(is_("PROCESSING")).alias("processing"), F.min_by("id", F.struct("batch_order", "id")).alias("first_id"))


def progress_percent(status: Column, done: Column, total: Column) -> Column:
    """100 at an end, up to 99 by pages done, 5 once it is under way, else 0."""
    return F.when(status.isin("READY", "FAILED"), 100).when(total > 0, F.least(F.lit(99), F.floor(done * F.lit(100.0) / total + 0.5))).when(status.isin("UPLOADED", "PROCESSING"), 5).otherwise(0).cast("int")


def counted(df: DataFrame, others: dict[str, tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """Add how many rows of each other table refer to a row: {name: (table, its column)}."""
    for name, (other, on) in others.items():
        n = other.groupBy(F.col(on).alias("__on")).agg(F.count("*").alias("__n"))
        df = df.join(n, F.col(key) == F.col("__on"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__on", "__n")
    return df


def subject_names(lines: DataFrame, questions: DataFrame, direct: DataFrame) -> DataFrame:
    """(paper_id, subjects): the sorted different subjects of a paper's questions and of the paper itself (direct: paper_id, subject)."""
    q = questions.select(F.col("id").alias("question_id"), "subject")
    both = lines.select("paper_id", "question_id").join(q, "question_id").select("paper_id", "subject").unionByName(direct.select("paper_id", "subject")).where("subject IS NOT NULL").distinct()
    return both.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("subjects"))


def facets(classrooms: DataFrame) -> DataFrame:
    """(facet, value): the different names, years, sections and subjects of classrooms."""
    columns = ["name", "year", "section", "subject"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return classrooms.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").distinct()


def paper_summary(papers: DataFrame) -> DataFrame:
    """(total, draft, published, archived)."""
    return papers.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("DRAFT", "PUBLISHED", "ARCHIVED")])


def composition(papers: DataFrame, lines: DataFrame, used: DataFrame) -> DataFrame:
    """(total, empty, composed, in_use): papers without questions, with some, and those that ``used`` (paper_id) refers to."""
    some = lines.select(F.col("paper_id").alias("__l")).distinct().withColumn("__has", F.lit(True))
    taken = used.select(F.col("paper_id").alias("__u")).distinct().withColumn("__used", F.lit(True))
    p = papers.join(some, F.col("id") == F.col("__l"), "left").join(taken, F.col("id") == F.col("__u"), "left")
    return p.agg(F.count("*").alias("total"), F.count_if(F.col("__has").isNull()).alias("empty"), F.count_if(F.col("__has")).alias("composed"), F.count_if(F.col("__used")).alias("in_use"))


def publish_gate(exams: DataFrame, questions: DataFrame, assignments: DataFrame, students: DataFrame, role: str, actor: int, now: str) -> DataFrame:
    """(id, error, status): the first reason why an exam can't be published, or the state that it passes to: live if it has opened.

    ``questions``, ``assignments`` and ``students`` have an exam_id; students are what the assignments come to.
    """
    have = lambda df, name: df.select(F.col("exam_id").alias(f"__{name}")).distinct().withColumn(name, F.lit(True))
    e = exams
    for name, df in (("q", questions), ("a", assignments), ("s", students)):
        e = e.join(have(df, name), F.col("id") == F.col(f"__{name}"), "left")
    error = first_error(
        (F.lit(role == "TEACHER") & (F.col("created_by") != actor), "not the author"),
        (F.col("kind") == "PAPER", "a paper"),
        (F.col("status") != "DRAFT", "not a draft"),
        (F.col("q").isNull(), "no questions"),
        (F.col("a").isNull(), "no assignments"),
        (F.col("closes_at") <= F.col("opens_at"), "closes before it opens"),
        (F.col("s").isNull(), "no students"),
    )
    e = e.withColumn("error", error)
    return e.select("id", "error", F.when(F.col("error").isNull(), F.when(F.col("opens_at") <= at(now), "LIVE").otherwise("SCHEDULED")).alias("status"))


def taxonomy_errors(rows: DataFrame, programs: DataFrame, subjects: DataFrame, chapters: DataFrame, topics: DataFrame) -> DataFrame:
    """Add error to rows (program_id, subject_id, chapter_id, topic_id, each may be null): the first of the chain that is unknown or
    stands under another parent. subjects have program_id, chapters subject_id, topics chapter_id."""
    add = lambda r, t, name, parent: r.join(t.select(F.col("id").alias(f"__{name}"), *([F.col(parent).alias(f"__{name}_of")] if parent else [])), F.col(f"{name}_id") == F.col(f"__{name}"), "left")
    r = rows
    for t, name, parent in ((programs, "program", None), (subjects, "subject", "program_id"), (chapters, "chapter", "subject_id"), (topics, "topic", "chapter_id")):
        r = add(r, t, name, parent)
    rules = []
    for name, above in (("program", None), ("subject", "program"), ("chapter", "subject"), ("topic", "chapter")):
        rules.append((F.col(f"{name}_id").isNotNull() & F.col(f"__{name}").isNull(), f"unknown {name}"))
        if above:
            rules.append((F.col(f"{name}_id").isNotNull() & F.col(f"{above}_id").isNotNull() & (F.col(f"__{name}_of") != F.col(f"{above}_id")), f"{name} of another {above}"))
    return r.withColumn("error", first_error(*rules)).select(*rows.columns, "error")


def question_errors(questions: DataFrame) -> DataFrame:
    """Add error to questions (type, payload JSON, options, right): the first rule that is broken, null for a good one.

    options and right are the numbers of labelled options and of right ones among them.
    """
    v, t = F.try_parse_json(F.coalesce("payload", F.lit("{}"))), F.col("type")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    is_ = lambda path, kind: F.coalesce(F.schema_of_variant(get(path, "variant")) == kind, F.lit(False))
    texts = lambda path: F.size(F.coalesce(get(path, "array<string>"), F.array().cast("array<string>")))
    number = lambda path, lo, hi: F.coalesce(get(path, "int").between(lo, hi) & is_(path, "BIGINT"), F.lit(False))
    n, right, content = F.coalesce("options", F.lit(0)), F.coalesce("right", F.lit(0)), F.length(get("$.contentHtml", "string"))
    choice = t.isin("SINGLE_CHOICE", "MULTIPLE_CHOICE")
    error = first_error(
        (v.isNull(), "payload is no JSON"),
        (F.coalesce(content > 50_000, F.lit(False)), "content too long"),
        ((t == "TRUE_FALSE") & ~is_("$.correct", "BOOLEAN"), "correct must be a boolean"),
        ((t == "FILL_BLANK") & (texts("$.accepted") < 1), "accepted must hold a text"),
        ((t == "FILL_BLANK") & ~is_("$.caseSensitive", "BOOLEAN"), "caseSensitive must be a boolean"),
        ((t == "MATCH_FOLLOWING") & (F.size(F.coalesce(get("$.pairs", "array<variant>"), F.array().cast("array<variant>"))) < 2), "two pairs at least"),
        ((t == "MATRIX_MATCH") & ((texts("$.rows") < 1) | (texts("$.cols") < 1)), "rows and cols must hold a text"),
        ((t == "MATRIX_MATCH") & get("$.correctMap", "map<string,array<string>>").isNull(), "correctMap must be an object"),
        ((t == "DESCRIPTIVE") & get("$.maxWords", "variant").isNotNull() & ~number("$.maxWords", 1, 10_000), "maxWords out of range"),
        ((t == "VISUAL") & ~F.coalesce(content >= 1, F.lit(False)), "content is missing"),
        ((t == "VISUAL") & ~number("$.optionCount", 2, 6), "optionCount out of range"),
        ((t == "VISUAL") & ~n.between(2, 6), "2 to 6 options"),
        ((t == "VISUAL") & (right != 1), "exactly one right option"),
        (choice & (n < 2), "two options at least"),
        ((t == "SINGLE_CHOICE") & (right != 1), "exactly one right option"),
        ((t == "MULTIPLE_CHOICE") & (right < 1), "a right option at least"),
        (~choice & (t != "VISUAL") & (n > 0), "no options allowed"),
    )
    return questions.withColumn("error", error)


def _resequenced(drafts: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.col("question_number").asc_nulls_last(), "position", "id")
    return drafts.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def insert_draft(drafts: DataFrame, job: int, number: int, new_id: int) -> DataFrame:
    """A job's drafts with a new one at this number: those from it on move up by one, and positions follow the numbers."""
    own = drafts.where(F.col("job_id") == job).select("job_id", "id", "position", "question_number")
    moved = own.withColumn("question_number", F.when(F.col("question_number") >= number, F.col("question_number") + 1).otherwise(F.col("question_number")))
    new = own.sparkSession.range(1).select(F.lit(job).cast("long").alias("job_id"), F.lit(new_id).cast("long").alias("id"), F.lit(0).cast("long").alias("position"), F.lit(number).cast("int").alias("question_number"))
    return _resequenced(moved.unionByName(new))


def move_draft(drafts: DataFrame, job: int, draft: int, number: int) -> DataFrame:
    """A job's drafts after one of them gets another number: those between the old and the new one close up or make room.

    A draft without a number takes a number that is free; if it is taken nothing changes.
    """
    own = drafts.where(F.col("job_id") == job).select("job_id", "id", "position", "question_number")
    old = own.where(F.col("id") == draft).agg(F.max("question_number").alias("__old"))
    taken = own.where((F.col("question_number") == number) & (F.col("id") != draft)).agg((F.count("*") > 0).alias("__taken"))
    d = own.crossJoin(F.broadcast(old)).crossJoin(F.broadcast(taken))  # one row each
    q, was = F.col("question_number"), F.col("__old")
    blocked = was.isNull() & F.col("__taken")
    after = F.when(blocked, q).when(F.col("id") == draft, number).when((q >= number) & (q < was), q + 1).when((q > was) & (q <= number), q - 1).otherwise(q)
    return _resequenced(d.withColumn("question_number", after.cast("int")).drop("__old", "__taken"))


def cloned(parents: DataFrame, children: DataFrame, key: str, chosen: Column, offset: int) -> tuple[DataFrame, DataFrame]:
    """Copies of chosen parents and of their children, under ids that are ``offset`` higher, and with '(copy)' behind the title."""
    p = parents.where(chosen)
    copies = p.withColumns({"source_id": F.col("id"), "id": F.col("id") + offset, "title": F.concat("title", F.lit(" (copy)")), "status": F.lit("DRAFT")})
    return copies, children.join(p.select(F.col("id").alias(key)), key, "left_semi").withColumn(key, F.col(key) + offset)


def exam_from_paper(papers: DataFrame, lines: DataFrame, paper: int, exam_id: int, negative: float) -> tuple[DataFrame, DataFrame]:
    """A draft exam of a paper's questions, in their order; its total stays 0 until it is recomputed."""
    exam = papers.where(F.col("id") == paper).select(F.lit(exam_id).cast("long").alias("id"), "title", F.lit("TEST").alias("kind"), F.lit("DRAFT").alias("status"), F.lit(0).cast("decimal(12,2)").alias("total_marks"))
    own = lines.where(F.col("paper_id") == paper)
    at_ = F.row_number().over(Window.partitionBy("paper_id").orderBy("position", "question_id")) - 1
    return exam, own.select(F.lit(exam_id).cast("long").alias("exam_id"), "question_id", at_.cast("int").alias("position"), "marks", F.lit(negative).cast("decimal(5,2)").alias("negative_marks"))


def named(rows: DataFrame, subjects: DataFrame, chapters: DataFrame) -> DataFrame:
    """Add subject and chapter texts to rows (subject_id, chapter_id, subject_text): the resolved name, else the supplied text; a chapter only if resolved."""
    s, c = (t.select(F.col("id").alias(f"{n}_id"), F.col("name").alias(f"__{n}")) for t, n in ((subjects, "subject"), (chapters, "chapter")))
    return rows.join(s, "subject_id", "left").join(c, "chapter_id", "left").withColumns({"subject": F.coalesce("__subject", "subject_text"), "chapter": F.col("__chapter")}).drop("__subject", "__chapter")


def batch_order(files: DataFrame) -> DataFrame:
    """(batch_id, id, batch_order, error): files in order of their creation; a batch with a repeated id or with a file that isn't pending is refused whole."""
    bad = files.groupBy(F.col("batch_id").alias("__b")).agg((F.count("*") > F.count_distinct("id")).alias("twice"), F.bool_or(F.col("status") != "PENDING").alias("begun"))
    error = first_error((F.col("twice"), "a file twice"), (F.col("begun"), "a file that isn't pending"))
    f = files.join(bad, F.col("batch_id") == F.col("__b")).withColumn("error", error)
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("created_at", "id")) - 1
    return f.select("batch_id", "id", F.when(F.col("error").isNull(), n).cast("int").alias("batch_order"), "error")


def draft_after(status: Column, action: Column) -> Column:
    """A draft's state after 'edit', 'discard' or 'revert'; null where that isn't allowed."""
    return (
        F.when((action == "edit") & ~status.isin("APPROVED", "DISCARDED"), "EDITED")
        .when((action == "discard") & (status != "APPROVED"), "DISCARDED")
        .when((action == "revert") & (status == "APPROVED"), "EDITED")
    )


def upload_after(status: Column, path: Column) -> Column:
    """A pending upload's state once its file is there: papers go on to processing, images and answer keys are done; null for others."""
    silent = F.contains(path, F.lit("/question-images/")) | F.contains(path, F.lit("/answer-keys/"))
    return F.when(status == "PENDING", F.when(silent, "UPLOADED").otherwise("PROCESSING"))


def classroom_conflicts(classrooms: DataFrame) -> DataFrame:
    """Classrooms whose branch, name, year and section, trimmed and in capitals, another one has too, with the smallest id of these."""
    norm = lambda c: F.upper(F.trim(F.col(c).cast("string"))).alias(c)
    rows = classrooms.select("id", "branch_id", norm("name"), norm("year"), norm("section"))
    keys = ["branch_id", "name", "year", "section"]
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    same = [rows[k].eqNullSafe(twice[k]) for k in keys]
    return rows.join(twice, reduce(lambda a, b: a & b, same)).select("id", "first_id", "n")


def soft_deleted(df: DataFrame, chosen: Column, now: str, column: str = "deleted_at") -> DataFrame:
    """Chosen rows get a time of deletion, once: those that have one keep it."""
    return df.withColumn(column, F.when(F.col(column).isNull() & chosen, at(now)).otherwise(F.col(column)))


def patched(df: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the values that a patch (key, columns) supplies; null stands for not supplied."""
    fields = [c for c in patches.columns if c != key]
    p = patches.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    return df.join(p, F.col(key) == F.col("__key"), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).drop("__key", *[f"__{c}" for c in fields])


def approvals(drafts: DataFrame) -> DataFrame:
    """(id, ok, error): each draft is approved on its own; what hinders one doesn't hinder the others."""
    error = first_error((F.col("status") == "APPROVED", "already approved"), (F.col("status") == "DISCARDED", "discarded"), (F.coalesce("explicit_subject", "assigned_subject").isNull(), "no subject"))
    return drafts.select("id", error.isNull().alias("ok"), error.alias("error"))


def appended_rows(existing: DataFrame, new: DataFrame, *unique: str) -> DataFrame:
    """A table with new rows added, those whose key it has, and repeats among the new ones, left out."""
    return existing.unionByName(new.dropDuplicates(list(unique)).join(existing, list(unique), "left_anti").select(existing.columns))


def upserted_rows(existing: DataFrame, new: DataFrame, *unique: str) -> DataFrame:
    """A table in which new rows replace those of the same key."""
    return existing.join(new, list(unique), "left_anti").select(existing.columns).unionByName(new.select(existing.columns))
