"""Drafts of questions from the regions of pages, questions that go on over a page's end, and where missing ones were lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators import geometry as ge
from gradeloom.operators.geometry import PAGE
from gradeloom.sources.store import dealt, kept, written

#: Pages of a block: what a page takes from the pages before it is settled within blocks, then over the blocks' ends,
#: so that no task sorts more than so many rows of a job of up to ``BLOCK`` squared pages.
BLOCK = 4096


def carried(df: DataFrame, by: list[str], at: str, last: dict[str, str], total: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Add, for each row in order of ``at`` (a number, unique in its group), what comes before it: the latest non-null
    value of columns (``last``: new name -> column) and sums of columns (``total``).

    Every row is a step of a scan (keep what there is, or replace it; add to a sum), and steps compose: a block of
    rows is a step of its own. So rows are scanned within blocks and blocks over their group.
    """
    d = df.withColumn("__b", F.floor(F.col(at) / block))
    inner = Window.partitionBy(*by, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    steps = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"__l_{n}") for n, c in last.items()] + [F.sum(c).alias(f"__t_{n}") for n, c in total.items()]
    ends = d.groupBy(*by, "__b").agg(*steps)
    ends = ends.select(*by, "__b", *[F.last(f"__l_{n}", True).over(outer).alias(f"__p_{n}") for n in last], *[F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__p_{n}") for n in total])
    new = {n: F.coalesce(F.last(c, True).over(inner), F.col(f"__p_{n}")) for n, c in last.items()} | {n: F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"__p_{n}") for n, c in total.items()}
    return d.join(ends, [*by, "__b"]).withColumns(new).drop("__b", *[f"__p_{n}" for n in new])


def top_number(ws: Column, h: Column, q_punct: Column) -> Column:
    """The number of the uppermost question marker among a region's words {y0, x0, x1, y1, text, word_id}; null for none."""
    middle = lambda w: (w["y0"] + w["y1"]) / 2
    behind = lambda w: F.exists(ws, lambda o: (F.abs(middle(o) - middle(w)) <= 0.6 * h) & (o["word_id"] != w["word_id"]) & (o["x1"] <= w["x0"]) & (w["x0"] - o["x1"] < 2 * h))
    read = F.filter(F.transform(ws, lambda w: F.struct(w.alias("w"), ge.number_at(w["text"]).alias("m"))), lambda x: x["m"]["punct"].isin("Q") | (x["m"]["punct"] == q_punct))
    starts = F.filter(read, lambda x: (x["m"]["num"].isNull() | (x["m"]["num"] <= ge.MOST_QUESTIONS)) & ~behind(x["w"]))
    return F.array_min(F.transform(starts, lambda x: F.struct(x["w"]["y0"], x["w"]["x0"], x["w"]["word_id"], x["m"]["num"].alias("num"))))["num"]


def _described(boxes: DataFrame, words: DataFrame, texts: bool) -> DataFrame:
    """Boxes with what their words say, and without the words: whether they are many or long matters to no later step."""
    ws, q = F.col("ws"), F.col("q_punct")
    said = {"question_number": top_number(ws, F.col("h"), q), "kind": ge.block_class(ws, q), "stem": ge.has_stem(ws, q), "options": ge.option_count(ws), "words": F.size(ws)}
    if texts:
        said["text"] = F.array_join(F.transform(F.array_sort(F.transform("ws", lambda w: F.struct(w["word_id"], w["text"]))), lambda w: w["text"]), " ")
    return ge.with_words(boxes, words).withColumns(said).drop("ws", "q_punct", "h")


def drafts_of_regions(words: DataFrame, regions: DataFrame, marks: DataFrame, width: float, height: float, pages: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """One draft a region, in order of page, column and height, with questions stitched over pages.

    ``words`` as in ``geometry``, ``regions`` as from ``regions``, ``marks`` the validated markers in columns. A page
    without markers is one draft as large as the page; regions without words are left out elsewhere. A draft whose
    crop has neither number nor stem is an ``invalid_crop``. The last region of a page with markers, where it reaches
    the page's end, stays open; the next page that was read closes it, and if that page has a line's height of
    content above the first marker of its first column, that content (``header_*``) belongs to the open question,
    which then ends there (``span_page_end``) and needs review. ``pages`` (job_id, page) are those that were read;
    without it the pages that have words. A page that was not read leaves a question open. Without ``texts`` drafts
    have no text, which is as large as the words.

    Rows with a null job or page take no part; empty tables give an empty result. What is given may go once this returns.
    """
    heights = written(ge.median_heights(words).where("job_id IS NOT NULL AND page IS NOT NULL"))
    top = F.min(F.when(F.col("y0").isNotNull(), F.struct("col", F.col("y0").cast("double").alias("y0"))))
    cols = marks.groupBy(*PAGE).agg(F.size(F.collect_set("col")).alias("n_cols"), F.min("col").alias("col"), top.alias("top"), F.min_by("left", "col").alias("first_left"), F.min_by("right", "col").alias("first_right"))
    cols = cols.withColumn("top", F.when(F.col("top.col") == F.col("col"), F.col("top.y0")))
    read = (heights if pages is None else pages).select(*PAGE).where("job_id IS NOT NULL AND page IS NOT NULL").distinct()
    whole = read.join(cols, PAGE, "left_anti").join(heights, PAGE, "left")
    box = {"x0": 0.0, "y0": 0.0, "x1": float(width), "y1": float(height)}
    whole = whole.select(*PAGE, F.lit(0).alias("col"), F.coalesce("h", F.lit(20.0)).alias("h"), F.lit(")").alias("q_punct"), F.lit(0).alias("place"), *[F.lit(v).alias(k) for k, v in box.items()])
    given = regions.select(*PAGE, F.col("col").cast("int").alias("col"), F.col("h").cast("double").alias("h"), "q_punct", F.col("place").cast("int").alias("place"), *[F.col(k).cast("double").alias(k) for k in box])
    r = _described(given, words, texts).unionByName(_described(whole, words, texts))
    order = Window.partitionBy(*PAGE).orderBy("col", "y0", "place")
    r = r.join(cols.select(*PAGE, "n_cols"), PAGE, "left").withColumns({"n_cols": F.coalesce("n_cols", F.lit(0)), "last": F.lead(F.lit(1)).over(order).isNull()})
    r = r.where("x1 > x0 AND y1 > y0 AND (words > 0 OR n_cols = 0)")
    r = r.withColumn("invalid_crop", (F.col("n_cols") > 0) & F.col("question_number").isNull() & ~F.col("stem"))
    less = lambda c, when, by: F.when(when, F.greatest(F.lit(0.1), c - by)).otherwise(c)
    sure = ge.region_confidence(F.col("y0"), F.col("y1"), F.col("words"), F.col("options"), F.col("last"), height)
    sure = less(less(sure, F.col("kind") == "UNKNOWN", 0.2), (F.col("kind") == "MCQ") & ~F.col("stem"), 0.3)
    r = r.withColumn("sure", F.when(F.col("invalid_crop"), F.least(sure, F.lit(0.3))).otherwise(sure))
    r = written(r.withColumn("index", (F.row_number().over(order) - 1).cast("int")).drop("stem"))
    # every page that was read replaces the open question: by its own last draft, or by none
    own = r.groupBy(*PAGE).agg(F.count("*").alias("n"), F.max(F.when(F.col("last") & (F.col("y1") >= height - 2) & (F.col("n_cols") > 0), F.col("index"))).alias("open_index"))
    steps = read.join(own, PAGE, "left").join(cols.drop("n_cols", "col"), PAGE, "left").join(heights, PAGE, "left")
    steps = steps.select(*PAGE, F.coalesce("n", F.lit(0)).alias("n"), F.struct(F.col("page").alias("page"), F.col("open_index").alias("index")).alias("open"), "top", "first_left", "first_right", "h")
    steps = carried(steps, ["job_id"], "page", {"open_in": "open"}, {"offset": "n"})
    rounded = lambda c: F.floor(c + 0.5).cast("double")
    steps = written(steps.withColumns({"header_y1": rounded(F.col("top") - F.col("h") * 0.4), "header_x0": F.greatest(F.lit(0.0), rounded(F.col("first_left") - F.col("h") * 0.4)), "header_x1": F.least(F.lit(float(width)), rounded(F.col("first_right")))}))
    goes_on = steps.where("open_in.index IS NOT NULL AND header_y1 >= h").select("job_id", F.col("open_in.page").alias("page"), F.col("open_in.index").alias("open"), F.col("page").alias("span_page_end"), "header_x0", "header_x1", "header_y1")
    # a page leaves one question open at most, so drafts meet what goes on by their page alone
    out = r.join(steps.select(*PAGE, "offset").join(goes_on, PAGE, "left"), PAGE)
    stitched = F.coalesce(F.col("open") == F.col("index"), F.lit(False))
    of_open = [F.when(stitched, F.col(k)).alias(k) for k in ("span_page_end", "header_x0", "header_x1", "header_y1")]
    confidence = F.when(stitched, F.least("sure", F.lit(0.55))).otherwise(F.col("sure"))
    return out.select(
        *PAGE, "col", "n_cols", (F.col("offset") + F.col("index")).cast("int").alias("position"), "question_number", "kind", "options", confidence.alias("confidence"), "invalid_crop",
        (stitched | (F.col("sure") < 0.6) | F.col("invalid_crop")).alias("needs_review"), *["text"] * texts, "words", *box, *of_open,
    )


def clean_words(words: DataFrame) -> DataFrame:
    """Words without watermarks; tokens that look like question numbers stay, and misread numbers are set right."""
    return ge.watermarked(words).where(~F.col("mark") | ge.number_at(F.col("text")).isNotNull()).drop("mark")


def drafts_of_pages(words: DataFrame, width: float, height: float, pages: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """Questions of whole pages, from their words on: watermarks left out, misread numbers set right, markers in columns,
    regions cut at inner numbers and at gaps of the sequence, then ``drafts_of_regions``.

    Where lines begin doesn't depend on texts, so the tokens with numbers that begin one are looked for once, and
    misread numbers are set right among them before the words are. Words and these tokens are kept as they are dealt out by
    page: words are shuffled once (by the caller, if they come ``dealt`` by page). What is made of them is small and written,
    so that no plan holds the plans of those before it.
    """
    words = clean_words(words.select(*PAGE, "word_id", "text", "x0", "y0", "x1", "y1"))
    with kept(words) as words, kept(dealt(ge.number_starts(words), PAGE)) as starts:
        for fix in (ge.truncated_numbers, ge.century_numbers):
            fixed = written(fix(ge.in_columns(ge.question_markers(starts, None, starts), width)))
            starts, words = ge.corrected(starts, fixed), ge.corrected(words, fixed)
        marks = written(ge.valid_sequence(ge.in_columns(ge.question_markers(starts, starts=starts), width)))
        cut = written(ge.split_regions(ge.regions(marks, width, height), words, starts))
        return drafts_of_regions(words, written(ge.gap_splits(cut, words, starts)), marks, width, height, pages, texts)


# --- where missing questions were lost


def numbers_read(words: DataFrame) -> DataFrame:
    """(page, word_id, num, x, y): numbers of up to three digits that tokens begin with, wherever they stand."""
    t = F.regexp_replace(F.trim("text"), ge.NOISE, "")
    w = words.withColumn("num", F.nullif(F.regexp_extract(t, r"^(\d{1,3})(?!\d)", 1), F.lit("")).cast("int")).where("num IS NOT NULL")
    return w.select(*PAGE, "word_id", "num", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))


def column_name(col: Column, n: Column) -> Column:
    return F.when(col.isNull(), None).when(n.isNull() | (n <= 1), "Single").when(col == 0, "Left").when((col == 1) & (n == 2), "Right").otherwise(F.concat(F.lit("Col "), (col + 1).cast("string")))


def missing_numbers(drafts: DataFrame, expected: int | None = None) -> DataFrame:
    """(job_id, num, previous, next): numbers that no valid draft of a job has, with the neighbours that are there.

    With ``expected`` numbers run from 1 to it, else from the smallest found to the largest. Only stretches between
    numbers are expanded.
    """
    valid = drafts.where(~F.coalesce("invalid_crop", F.lit(False)))
    have = valid.where("question_number IS NOT NULL").select("job_id", F.col("question_number").cast("int").alias("n")).distinct()
    w = Window.partitionBy("job_id").orderBy("n")
    pairs = have.select("job_id", F.col("n").alias("previous"), F.lead("n").over(w).alias("next"))
    if expected:
        jobs = drafts.select("job_id").distinct().join(have.groupBy("job_id").agg(F.min("n").alias("next")), "job_id", "left")
        pairs = pairs.unionByName(jobs.select("job_id", F.lit(None).cast("int").alias("previous"), "next"))
    a = F.greatest(F.coalesce(F.col("previous") + 1, F.lit(1)), F.lit(1)) if expected else F.col("previous") + 1
    z = F.least(F.coalesce(F.col("next") - 1, F.lit(expected)), F.lit(expected)) if expected else F.col("next") - 1
    return pairs.where(a <= z).select("job_id", F.explode(F.sequence(a, z)).alias("num"), "previous", "next")


def missing_trace(drafts: DataFrame, read: DataFrame, markers: DataFrame, kept: DataFrame, expected: int | None = None) -> DataFrame:
    """Every missing number of a job with where it was lost first: OCR_MISS (never read), MARKER_MISS (read, but no marker),
    SEQUENCE_REMOVED (a marker, but out of sequence), NOT_SPLIT (inside the crop of another question) or UNKNOWN.

    ``drafts`` as from ``drafts_of_regions``; ``read`` as from ``numbers_read``; ``markers`` and ``kept`` (job_id, num) are
    what marker detection found and what sequence validation kept. page and column are those of the crop that holds
    the number's first token, else that token's page and the neighbour's column, else the neighbour's (the one before
    goes first).
    """
    m = missing_numbers(drafts, expected)
    first = m.join(read, ["job_id", "num"]).groupBy("job_id", "num").agg(F.min(F.struct("page", "word_id", "x", "y")).alias("at"))
    d = drafts.select("job_id", "page", "position", "question_number", "col", "n_cols", F.coalesce("invalid_crop", F.lit(False)).alias("invalid"), *[F.col(k).alias(f"d_{k}") for k in ("x0", "y0", "x1", "y1")])
    at = first.select("job_id", "num", F.col("at.page").alias("page"), "at.x", "at.y").join(d.drop("invalid"), PAGE)
    holds = (F.col("x") >= F.col("d_x0") - 2) & (F.col("x") < F.col("d_x1") + 2) & (F.col("y") >= F.col("d_y0") - 2) & (F.col("y") < F.col("d_y1") + 2)
    host = at.where(holds).groupBy("job_id", "num").agg(F.min(F.struct("position", "question_number", "col", "n_cols")).alias("host"))
    near = d.where("NOT invalid AND question_number IS NOT NULL").groupBy("job_id", F.col("question_number").alias("n")).agg(F.min(F.struct("position", "page", "col", "n_cols")).alias("d"))
    flag = lambda t, name: t.where("num IS NOT NULL").select("job_id", "num").distinct().withColumn(name, F.lit(True))
    out = m.join(first, ["job_id", "num"], "left").join(host, ["job_id", "num"], "left").join(flag(markers, "m"), ["job_id", "num"], "left").join(flag(kept, "k"), ["job_id", "num"], "left")
    out = out.withColumn("n", F.coalesce("previous", "next")).join(near, ["job_id", "n"], "left")
    seen, marked, stays = F.col("at").isNotNull(), F.col("m").isNotNull(), F.col("k").isNotNull()
    inside = F.col("host.question_number")
    stage = F.when(~seen, "OCR_MISS").when(~marked, "MARKER_MISS").when(~stays, "SEQUENCE_REMOVED").when(inside.isNotNull(), "NOT_SPLIT").otherwise("UNKNOWN")
    column = F.coalesce(F.when(F.col("host").isNotNull(), column_name(F.col("host.col"), F.col("host.n_cols"))), column_name(F.col("d.col"), F.col("d.n_cols")))
    return out.select("job_id", F.col("num").alias("expected"), "previous", "next", F.coalesce(F.col("at.page"), F.col("d.page")).alias("page"), column.alias("column"), seen.alias("ocr_detected"), marked.alias("marker_detected"), (marked & ~stays).alias("removed_in_sequence"), inside.alias("merged_into"), stage.alias("stage"))


def crowded_crops(drafts: DataFrame) -> DataFrame:
    """(job_id, position, numbers): valid crops whose text holds two or more different question numbers."""
    found = F.regexp_extract_all("text", F.lit(r"(?:^|\s)(\d{1,3})[.)](?!\d)"), F.lit(1))
    numbers = F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))
    return drafts.where(~F.coalesce("invalid_crop", F.lit(False))).select("job_id", "position", numbers.alias("numbers")).where(F.size("numbers") >= 2)


def review_counts(drafts: DataFrame) -> DataFrame:
    """(job_id, numberless, needs_review): positions of valid drafts without a number, and how many drafts need review."""
    valid = ~F.coalesce("invalid_crop", F.lit(False))
    return drafts.groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(valid & F.col("question_number").isNull(), F.col("position")))).alias("numberless"), F.count_if("needs_review").alias("needs_review"))
