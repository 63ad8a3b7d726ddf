"""Answer keys in free text: pairs of question number and answer, found, checked and given to drafts, with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A separator or an opening bracket stands between number and answer; an optional "Q" or "Question" before; no
# letter, digit or opening bracket directly before, no letter or digit directly after.
SEPARATOR = r"[\s\-–—.:)=>→,]"
_FRAME = r"(?i)(?<![0-9A-Za-z(])(?:Q(?:uestion)?\s*\.?\s*)?(\d{1,4})(?:" + SEPARATOR + r"+\(?|\s*\()\s*(ANSWER)\s*\)?(?![0-9A-Za-z])"
PAIR = _FRAME.replace("ANSWER", "TRUE|FALSE|[A-H]|[1-8]")
LOOSE = _FRAME.replace("ANSWER", "[A-Za-z0-9]{1,2}")
DRAFT_NUMBER = r"(?i)^\s*(?:Q(?:uestion)?\.?\s*)?(\d{1,3})\s*[.)\s]"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key), F.explode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("line"))


def _found(lines: DataFrame, key: str, pattern: str) -> DataFrame:
    zipped = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("a"))
    return lines.select(key, F.explode(zipped).alias("p")).select(key, F.col("p.n").cast("int").alias("number"), F.col("p.a").alias("raw"))


def canonical(raw: Column) -> Column:
    """Letters as 1 to 8, digits as they are, TRUE and FALSE in capitals."""
    up = F.upper(raw)
    letter = F.instr(F.lit("ABCDEFGH"), up)
    return F.when((F.length(up) == 1) & (letter > 0), letter.cast("string")).otherwise(up)


def key_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, number, answer): every pair of a text, line by line, so that none spans a line's end; repeats stay."""
    return _found(_lines(docs, key, text), key, PAIR).select(key, "number", canonical(F.col("raw")).alias("answer"))


def pair_count(text: Column) -> Column:
    """How many pairs a text holds."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: F.size(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, n: a + n)


#: A token of a key as a number: the question's number above SHIFT bits, below it an answer (1 to 10) or, from OTHER, two characters.
SHIFT, OTHER = 14, 64
ANSWERS, CHARACTERS = [*"12345678", "TRUE", "FALSE"], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _tokens(text: Column) -> Column:
    """The answers of a text and, behind a number, what is none or has a number below 1; repeats stay."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")

    def found(pattern, token):
        part = lambda line, group: F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
        return F.flatten(F.transform(lines, lambda line: F.filter(F.zip_with(part(line, 1), part(line, 2), lambda n, raw: token(n.cast("int"), raw)), lambda x: x.isNotNull())))

    at = lambda raw, i: F.instr(F.lit(CHARACTERS), F.substring(raw, i, 1))
    valid = lambda raw: F.upper(raw).rlike("^(TRUE|FALSE|[A-H]|[1-8])$")
    strict = found(PAIR, lambda n, raw: F.shiftleft(n, SHIFT) + F.array_position(F.array(*map(F.lit, ANSWERS)), canonical(raw)).cast("int"))
    second = lambda raw: F.when(F.length(raw) > 1, at(raw, 2)).otherwise(0)
    loose = found(LOOSE, lambda n, raw: F.when(~valid(raw) | (n < 1), F.shiftleft(n, SHIFT) + OTHER + at(raw, 1) * 64 + second(raw)))
    return F.concat(strict, loose)


def _parsed(docs: DataFrame, key: str, text: str, each_once: bool) -> DataFrame:
    """(key, p): what ``key_parse`` gives, as one array a key that has any, in order of number. Nothing is grouped that is in one row."""
    t = docs.select(key, _tokens(F.col(text)).alias("t"))
    if not each_once:
        t = t.groupBy(key).agg(F.flatten(F.collect_list("t")).alias("t"))
    # by number, answers first; a generator's output, as filters on it or on what follows would be pushed into what makes it
    t = t.select(key, F.explode_outer(F.array(F.array_sort("t"))).alias("t")).where(F.size("t") > 0)
    new = F.transform("t", lambda x, i: F.when((i == 0) | (F.shiftright(F.get("t", i - 1), SHIFT) != F.shiftright(x, SHIFT)), i))
    t = t.select(key, "t", F.array_compact(new).alias("b"))
    t = t.select(key, F.transform("b", lambda x, i: F.slice("t", x + 1, F.coalesce(F.get("b", i + 1), F.size("t")) - x)).alias("runs"))
    low = lambda x: x.bitwiseAND((1 << SHIFT) - 1)
    row = lambda number, answer, n, state: F.struct(number.alias("number"), answer.cast("string").alias("answer"), n.cast("long").alias("n"), state.alias("state"))
    none = F.lit(None).cast("string")
    char = lambda i: F.when(i > 0, F.substring(F.lit(CHARACTERS), i, F.lit(1))).otherwise("")

    def said(number, answers):
        n, first, last = F.size(answers), F.get(answers, F.lit(0)), F.get(answers, F.size(answers) - 1)
        state = F.when(number < 1, "rejected").when(first != last, "conflict").when(n > 1, "duplicate").otherwise("entry")
        return row(number, F.when((number >= 1) & (first == last), F.get(F.array(*map(F.lit, ANSWERS)), low(first) - 1)), n, state)

    def other(number, r):
        token = lambda x: F.concat(char(F.floor((low(x) - OTHER) / 64).cast("int")), char(low(x) % 64))
        return F.transform(F.array_distinct(r), lambda x: row(number, token(x), F.size(F.filter(r, lambda y: y == x)), F.lit("invalid")))

    def run(r):
        number = F.shiftright(F.get(r, F.lit(0)), SHIFT)
        answers = F.filter(r, lambda x: low(x) < OTHER)
        return F.when(low(F.get(r, F.lit(0))) < OTHER, F.transform(F.array(answers), lambda a: said(number, a))).when(number < 1, F.array(row(number, none, F.size(r), F.lit("rejected")))).otherwise(other(number, r))

    return t.select(key, F.flatten(F.transform("runs", run)).alias("p"))


def key_parse(docs: DataFrame, key: str = "doc_id", text: str = "text", each_once: bool = False) -> DataFrame:
    """(doc_id, number, answer, n, state), one row a number and, for 'invalid', a token.

    'entry', or 'duplicate' if said again alike; 'conflict' where answers differ, so none counts; 'rejected' for
    numbers below 1; 'invalid' where a number has only what is no answer (answer holds that token). A text is parsed
    within its row; ``each_once`` says that no two rows have the same key, so that they need not be brought together.
    """
    return _parsed(docs, key, text, each_once).select(key, F.inline_outer("p"))  # none is empty


def missing_numbers(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, number): numbers from 1 to a key's largest entry that have no entry."""
    have = parsed.where("state IN ('entry', 'duplicate')").groupBy(key).agg(F.collect_set("number").alias("have"))
    return have.select(key, F.explode(F.array_except(F.sequence(F.lit(1), F.array_max("have")), "have")).alias("number"))


def _report(g: DataFrame, key: str) -> DataFrame:
    none = F.array().cast("array<int>")
    missing = F.when(F.size("have") > 0, F.array_except(F.sequence(F.lit(1), F.array_max("have")), "have")).otherwise(none)
    return g.select(key, F.size("have").alias("entries"), F.coalesce(F.array_min("have") == 1, F.lit(True)).alias("starts_at_one"), missing.alias("missing"), "duplicates", "conflicts", "invalid", "rejected")


def key_report(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a key: entries, whether they start at one, and the numbers that are missing, said twice, in conflict, invalid or below 1."""
    of = lambda *s: F.array_sort(F.collect_set(F.when(F.col("state").isin(*s), F.col("number"))))
    twice = F.array_sort(F.collect_set(F.when((F.col("n") > 1) & F.col("state").isin("duplicate", "conflict"), F.col("number"))))
    return _report(parsed.groupBy(key).agg(of("entry", "duplicate").alias("have"), twice.alias("duplicates"), of("conflict").alias("conflicts"), of("invalid").alias("invalid"), of("rejected").alias("rejected")), key)


def text_report(docs: DataFrame, key: str = "doc_id", text: str = "text", each_once: bool = False) -> DataFrame:
    """What ``key_report`` gives for the parsed texts, without rows for their numbers; ``each_once`` as in ``key_parse``."""
    p = _parsed(docs, key, text, each_once)
    of = lambda holds: F.array_distinct(F.transform(F.filter("p", holds), lambda x: x["number"]))
    state = lambda *s: of(lambda x: x["state"].isin(*s))
    twice = of(lambda x: (x["n"] > 1) & x["state"].isin("duplicate", "conflict"))
    return _report(p.select(key, state("entry", "duplicate").alias("have"), twice.alias("duplicates"), state("conflict").alias("conflicts"), state("invalid").alias("invalid"), state("rejected").alias("rejected")), key)


def draft_number(text: Column) -> Column:
    """The number that a draft's text begins with, 1 to 999; null without one."""
    n = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), DRAFT_NUMBER, 1), F.lit("")).cast("int")
    return F.when(n >= 1, n)


def key_assign(drafts: DataFrame, parsed: DataFrame) -> DataFrame:
    """(draft_id, number, answer, state) of drafts (draft_id, doc_id, text, question_number, option_count, options_length).

    A draft's number is its own or that of its text; 'assigned', 'out_of_range' where the answer is an option beyond the
    larger of its two counts (0: no bound), else 'unmatched'. Key numbers without a draft come with a null draft_id as 'unused'.
    """
    entries = parsed.where("state IN ('entry', 'duplicate')").select("doc_id", F.col("number").alias("k_number"), "answer")
    d = drafts.withColumn("number", F.coalesce("question_number", draft_number(F.col("text"))))
    bound = F.greatest(F.coalesce("option_count", F.lit(0)), F.coalesce("options_length", F.lit(0)))
    option = F.when(F.col("answer").rlike("^[1-8]$"), F.col("answer")).cast("int")
    state = F.when(F.col("answer").isNull(), "unmatched").when(option.isNotNull() & (bound > 0) & (option > bound), "out_of_range").otherwise("assigned")
    match = [d["doc_id"] == entries["doc_id"], d["number"] == entries["k_number"]]
    out = d.join(entries, match, "left").select(d["doc_id"], "draft_id", "number", F.when(state == "assigned", F.col("answer")).alias("answer"), state.alias("state"))
    used = out.where("state = 'assigned'").select(F.col("doc_id").alias("u_doc"), F.col("number").alias("u_number")).distinct()
    unused = entries.join(used, [F.col("doc_id") == F.col("u_doc"), F.col("k_number") == F.col("u_number")], "left_anti")
    kind = out.schema["draft_id"].dataType
    return out.unionByName(unused.select("doc_id", F.lit(None).cast(kind).alias("draft_id"), F.col("k_number").alias("number"), "answer", F.lit("unused").alias("state")))
