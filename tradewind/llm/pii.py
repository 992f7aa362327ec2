"""Personal data: patterns of four kinds, and identifiers that the words around them give away.

Spans that match a kind's pattern are seeds. The two words before an identifier and the two after it are its lexical
patterns; patterns and identifiers make a graph. Patterns get a confidence from the members among their identifiers,
which at first are the seeds, and identifiers get one from their patterns; those of high confidence become members
and induce patterns in the next round, until nothing is added. All occurrences of members are spans then, though no
pattern of their kind fits.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, staged

KINDS = ["email", "ip", "card", "phone"]
# Possessive and anchored to the starts of runs, these find what the plain patterns find, in linear time:
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# [0-9]([\x20-]?[0-9])+   \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: A character that any match of a kind holds.
NEEDED = ["@", ".", None, "+"]
#: Written words with a digit or an @: what may be an identifier.
SHAPED = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
#: Two or more written words of digits, with one blank between: what may be an identifier in several words. What follows
#: the last one without a blank is a part of the match, so that no place is looked at twice.
RUN = r"(?<![^\x20\x09-\x0D])[(+]?[0-9]++[)]?(?:[.-][0-9]++)*+(?:\x20[(]?[0-9]++[)]?(?:[.-][0-9]++)*+)++[^\x20\x09-\x0D]*+"
#: Digits that an identifier other than an address has at least, and one in several words at most.
DIGITS, MOST = 5, 19
#: Rounds of discovery after which the members are one table again.
TOGETHER = 8
#: Confidence from which patterns and identifiers count, and distinct members that a pattern goes with at least.
CONFIDENT, MEMBERS = 0.8, 3
#: What an identifier that is no member weighs against a pattern; a member of another kind weighs 1.
UNKNOWN = 0.25
#: Characters before and after a span in which its patterns' words have to stand whole.
NEAR = 80

SPAN = "struct<start:int,kind:int,end:int,token:string>"


def _spans(text: str, pattern: str, kind: int) -> str:
    """SQL for an array of SPAN: the matches of a pattern in a text column, leftmost first."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    # The text between matches is one piece longer than the matches.
    return f"""aggregate(zip_with(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0), (gap, token) -> named_struct('gap', gap, 'token', token)),
        named_struct('at', 0, 'found', cast(array() as array<{SPAN}>)),
        (acc, x) -> if(x.token is null, acc, named_struct('at', acc.at + length(x.gap) + length(x.token), 'found', array_append(acc.found,
            named_struct('start', acc.at + length(x.gap), 'kind', {kind}, 'end', acc.at + length(x.gap) + length(x.token), 'token', x.token)))), acc -> acc.found)"""


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, token: Column) -> Column:
    digits = _digits(token)
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(token, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255", 3).otherwise(2))
    if kind == 2:
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def _checked(kind: int) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["token"])


def of_kind(spans: str, kind: int) -> Column:
    """Those of an array of spans that are of one kind."""
    return F.filter(spans, lambda s: s["kind"] == kind)


def base_spans(text: str) -> Column:
    """An array of (start, kind, end, token) of a text column, by start, then kind; kind counts through KINDS."""
    found = []
    for kind, (pattern, needed) in enumerate(zip(PATTERNS, NEEDED, strict=True)):
        there = F.col(text).contains(needed) if needed else F.col(text).rlike("[0-9][ -]?[0-9]")
        spans = F.when(there, F.filter(F.expr(_spans(text, pattern, kind)), _checked(kind)))
        found.append(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*found))


def _context(text: Column, start: Column, end: Column) -> Column:
    """The last two words before a place and the first two after it, each an empty text if there are fewer within NEAR characters; lower-cased, digits as 0."""
    before = F.substr(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))
    after = F.substr(text, end + 1, F.lit(NEAR))
    # Where the text goes on beyond NEAR, a word that reaches its edge may be longer.
    first = F.when(start > NEAR, F.regexp_extract(before, r"\s([^\s]+\s+[^\s]+)\s*$", 1)).otherwise(F.regexp_extract(before, r"(?:^|\s)([^\s]+\s+[^\s]+)\s*$", 1))
    last = F.when(F.length(text) - end > NEAR, F.regexp_extract(after, r"""^[.,;:!?)\]"']*\s+([^\s]+\s+[^\s]+)\s""", 1)).otherwise(F.regexp_extract(after, r"""^[.,;:!?)\]"']*\s+([^\s]+\s+[^\s]+)(?:\s|$)""", 1))
    return F.array(*(F.when(x != "", F.concat(F.lit(side), F.regexp_replace(F.lower(x), "[0-9]+", "0"))).otherwise("") for side, x in (("<", first), (">", last))))


def _runs(text: Column) -> Column:
    """The identifiers in several words that there may be, as an array of SPAN; signs after the last word are left out."""
    found = F.coalesce(F.when(text.rlike("[0-9)] [(0-9]"), F.expr(_spans("text", RUN, -1))), F.array().cast(f"array<{SPAN}>"))

    def cut(s: Column) -> Column:
        token = F.regexp_replace(s["token"], "[.,;:!?]+$", "")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] + F.length(token)).alias("end"), token.alias("token"))

    return F.filter(F.transform(found, cut), lambda s: s["token"].rlike(r"^[0-9()+.\x20-]*[0-9)]$") & F.length(_digits(s["token"])).between(DIGITS, MOST))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc, sha, base, other): each row's base spans, and other words and runs of words that may be identifiers; both with the patterns around them.

    keep: with row too, all columns of docs.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("base", base_spans("text"))
    other = F.when(F.col("text").rlike("[0-9@]"), F.expr(_spans("text", SHAPED, -1)))
    rows = rows.withColumn("other", F.coalesce(other, F.array().cast(f"array<{SPAN}>")))
    likely = F.filter("other", lambda s: s["token"].contains("@") | (F.length(_digits(s["token"])) >= DIGITS))
    rows = rows.withColumn("other", F.concat(likely, _runs(F.col("text"))))
    rows = rows.withColumn("other", F.filter("other", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    add = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token"), _context(F.col("text"), s["start"], s["end"]).alias("around")))
    return rows.select(*(["row"] if keep else []), "doc", "sha", add("base").alias("base"), add("other").alias("other"))


def members(found: DataFrame) -> DataFrame:
    """(token, kind) of the discovered identifiers, from occurrences().

    A pattern's confidence in a kind is the share of that kind's members among its distinct identifiers, of which
    those of no kind weigh UNKNOWN; an identifier's is that not all its patterns are wrong, and its kind the one it
    has most confidence in, of equals the first. Each round is a table of its own; rounds follow each other until one
    adds nothing, which comes, as each adds identifiers of the graph.
    """
    both = found.select(F.explode(F.concat("base", "other")).alias("s")).select(F.explode("s.around").alias("pattern"), "s.token", "s.kind").where("pattern <> ''")
    edges = staged(both.groupBy("pattern", "token").agg(F.max("kind").alias("own")), "edges")
    # A pattern of too few identifiers never counts.
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MEMBERS).select("pattern")
    edges = staged(edges.join(wide, "pattern", "left_semi"), "graph")
    seeds = edges.where("own >= 0").groupBy("token").agg(F.min("own").alias("kind"))
    known = staged(seeds.withColumn("round", F.lit(0)), "members")
    for n in count(1):
        told = edges.select("pattern", "token").join(known, "token", "left")
        counts = told.groupBy("pattern").agg(F.count_if(F.col("kind").isNull()).alias("unknown"), *(F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))))
        kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("n")) for k in range(len(KINDS))))
        every = sum((F.col(f"k{k}") for k in range(len(KINDS))), F.lit(0))
        sure = counts.select("pattern", (every + UNKNOWN * F.col("unknown")).alias("all"), F.inline(kinds)).where(F.col("n") >= MEMBERS)
        sure = staged(sure.select("pattern", "kind", (F.col("n") / F.col("all")).alias("confidence")).where(F.col("confidence") >= CONFIDENT), "patterns")
        fresh = edges.join(checked_broadcast(sure), "pattern").join(known.select("token"), "token", "left_anti")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        fresh = fresh.groupBy("token", "kind").agg((1 - wrong).alias("c")).where(F.col("c") >= CONFIDENT)
        fresh = fresh.groupBy("token").agg((-F.max(F.struct("c", -F.col("kind")))["col2"]).alias("kind"))
        fresh = staged(fresh.withColumn("round", F.lit(n)), "members")
        if fresh.isEmpty():
            break
        known = known.union(fresh)
        if n % TOGETHER == 0:
            known = staged(known, "members")
    return known.where("round > 0").select("token", "kind")


def discovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, sha, more): the further spans of rows that have some, all occurrences of members()."""
    few = checked_broadcast(staged(known.withColumnsRenamed({"token": "_token", "kind": "_kind"}), "known"))
    rows = found.select("doc", "sha", F.explode("other").alias("s")).join(few, F.col("s.token") == F.col("_token"))
    span = F.struct(F.col("s.start").alias("start"), F.col("_kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.token").alias("token"))
    return rows.groupBy("doc", "sha").agg(F.array_sort(F.collect_set(span)).alias("more"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sha, base, spans) of every row: the base spans, and those with the discovered ones, by start, then kind.

    Spans are (start, kind, end, token), in code points, end exclusive; kind counts through KINDS. A null text counts
    as empty. Null ids and repeated rows stay; an empty table gives an empty result; further columns are not read.
    """
    found = staged(occurrences(docs.select(id_col, text_col), id_col, text_col), "occurrences")
    joined = _with_more(found, discovered(found, members(found))).withColumn("base", _plain("base"))
    return joined.select(F.col("doc").alias(id_col), "sha", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def _plain(name: str) -> Column:
    return F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token")))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    other = checked_broadcast(staged(more, "more")).withColumnsRenamed({"doc": "_doc", "sha": "_sha"})
    joined = rows.join(other, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("sha") == F.col("_sha")), "left")
    return joined.withColumn("more", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))


def span_text(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans give one.

    Other columns and rows without spans stay as they are, null ids and texts and repeated rows too; texts have no
    bound of length. An empty table gives an empty result.
    """
    found = staged(occurrences(docs, id_col, text_col, keep=True), "occurrences")
    rows = _with_more(found, discovered(found, members(found)))
    rows = rows.withColumns({"text": F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")), "spans": F.array_sort(F.concat(_plain("base"), "more"))})
    names = F.array(*map(F.lit, KINDS))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("spans", begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"])))
    new = F.when(F.size("spans") > 0, folded).otherwise(F.col(f"row.{text_col}"))
    return rows.select(*((new if c == text_col else F.col(f"row.{c}")).alias(c) for c in docs.columns))
