"""Personal data in texts: base patterns, and identifiers found by bootstrapped contexts. DataFrame operations only.

Base spans come from one regular expression for each kind and a check of what matched. Every token
with a digit or an at sign is a candidate; its patterns are the word and the two words before it and
after it, where another candidate stands as a mark, and so do the start and the end of the text. Candidates that
overlap a base span are seeds. Seeds and candidates form a bipartite graph of patterns and
instances: a pattern is as good as the share of its instances that are known, less what chance could
give in a graph of so many patterns; an instance as the noisy-or of its patterns; and the scores are
passed to and fro a few times. Candidates of a fitting shape under patterns with enough known
instances and a high score are added; base spans stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import free_name, quoted, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; known instances that a pattern needs; least scores of patterns and instances.
ROUNDS, SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 5, 0.5, 0.6

#: The base rules. Starts that cannot be leftmost are excluded by look-behind, and repeats give nothing
#: back where that changes no match, so long runs cost linear time; \G is the end of the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The start and the end of a text stand for the words that it lacks.
START, END = " <start> <start> ", " <end> <end> "
#: The last two words of a text, and the first two.
LAST_TWO, FIRST_TWO = r"(?<!\S)(?:\S++\s++)?\S++\s*+\z", r"^\S*+\s*+((?:\S++(?:\s++\S++)?)?)"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Cards and phones may run over single blanks and brackets between tokens; the longest run that ends with a token counts.
_HEAD, _TAIL = r"^[^A-Za-z0-9@+(]*+", r"(?=[^A-Za-z0-9@\s]*(?:\s|$))"
RUNS = {
    "card": rf"{_HEAD}([0-9](?:[\x20-]?[0-9]){{11,18}}){_TAIL}",
    "phone": rf"{_HEAD}(\(?[0-9](?:[().-]{{0,2}}(?:\x20[().-]{{0,2}}){{0,2}}[0-9]){{6,14}}){_TAIL}",
}
#: What is tied to the token before it (by the gap and the token), and tokens of the longest run after its first: one digit each.
TIE, TIED, RUN_TOKENS = r"^\x20(?:[().-]{1,2}\x20)?$", r"^[().-]{0,2}[0-9][0-9().-]*[^A-Za-z0-9@]*$", 18
#: What an added identifier of a kind must look like, with the signs around it taken off.
SHAPES = {
    "email": r"^[^\s@]+@+[^\s@]*[A-Za-z][^\s@]*$",
    "ip": r"^(?=.*[0-9])[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}$",
    "card": r"^(?:[^0-9]?[0-9]){12,19}$",
    "phone": r"^\(?(?:[0-9][().-]{0,2}){7,15}$",
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Of a string of digits: from the right, every second one doubled and its digits summed."""
    at = F.sequence(F.lit(1), F.length(c))
    one = lambda i: F.substring(F.reverse(c), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, (one(i) * 2) % 10 + F.floor(one(i) * 2 / 10)).otherwise(one(i)).cast("int")
    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return c.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(digits(c))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(c))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


_MATCH = "struct<kind:int,i:int,pre:int,what:string,left:string,right:string,tie:string>"


def _found(text: Column, kind: int, pattern: str, context: bool = False) -> Column:
    """array of _MATCH of a pattern's matches: pre is the text's length since the last match, left and right the words beside it, tie the gap if it ties both."""
    what = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    left = (lambda p: F.regexp_extract(p, LAST_TWO, 0)) if context else (lambda p: F.lit(""))
    tie = (lambda p: F.regexp_extract(F.left(p, F.lit(5)), TIE, 0)) if context else (lambda p: F.lit(""))
    right = lambda p: F.regexp_extract(F.coalesce(p, F.lit("")), FIRST_TWO, 1)
    # Zipped, so that the text is split once and not for every match.
    one = lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(z["1"]).alias("pre"), z["0"].alias("what"), left(z["1"]).alias("left"), right(z["2"]).alias("right"), tie(z["1"]).alias("tie")
    )
    pieces = F.arrays_zip(what, between, F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))))
    matches = F.filter(F.transform(pieces, one), lambda m: m["what"].isNotNull())
    return F.when(F.size(what) > 0, matches).otherwise(F.array()).cast(f"array<{_MATCH}>")


def _marks(words: Column) -> Column:
    """Words with a digit or an at sign as the marks of candidates."""
    return F.regexp_replace(F.regexp_replace(words, r"(?<!\S)[^\s@]*+@\S*+", "<at>"), r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<num>")


def _context() -> dict[str, Column]:
    """What stands beside a match: for a candidate also marks of the next two on either side and the words between them."""
    order = Window.partitionBy("row", "kind").orderBy("i")
    at = lambda c, k: F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order)
    mark = lambda k, edge: F.when(at("what", k).isNull(), F.lit(edge)).when(at("what", k).contains("@"), F.lit(" <at> ")).otherwise(F.lit(" <num> "))
    none = lambda c: F.coalesce(c, F.lit(""))
    left = F.concat(mark(2, START), none(at("left", 1)), mark(1, START), "left")
    right = F.concat("right", mark(-1, END), none(at("right", -1)), mark(-2, END))
    candidate = F.col("kind") == len(KINDS)
    return {"left": F.when(candidate, left).otherwise(F.lit("")), "right": F.when(candidate, right).otherwise(F.concat(_marks(F.col("right")), F.lit(END)))}


def _runs() -> dict[str, Column]:
    """By kind, the run that begins with a candidate, or an empty string."""
    after = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(1, RUN_TOKENS)
    tied = F.when((F.col("tie") != "") & F.col("what").rlike(TIED), F.concat("tie", "what")).otherwise(F.lit("\n"))
    text = F.concat("what", F.array_join(F.collect_list(tied).over(after), ""))
    return {f"run_{k}": F.when(F.col("kind") == len(KINDS), F.regexp_extract(text, r, 1)).otherwise(F.lit("")) for k, r in RUNS.items()}


def _placed(docs: DataFrame, numbered: bool) -> DataFrame:
    """Every match of every row with its place (code points), and a row of kind -1 for each row: one shuffle of small rows."""
    text = F.col("text")
    nothing = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("pre"), F.lit("").alias("what"), F.lit("").alias("left"), F.lit("").alias("right"), F.lit("").alias("tie")))
    found = [_found(text, k, BASE[name]) for k, name in enumerate(KINDS)] + [_found(text, len(KINDS), CANDIDATE, True)]
    rows = docs.select("row" if numbered else F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    rows = rows.select("row", "doc_id", F.explode(F.concat(nothing, *found)).alias("m")).select("row", "doc_id", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("pre") + F.length("what")).over(before) - F.length("what")
    rows = rows.repartition("row").withColumn("start", start).withColumns({**_context(), **_runs()}).drop("tie")
    checked = F.lit(True)
    for k, name in enumerate(KINDS):
        checked = F.when(F.col("kind") == k, valid(name, F.col("what"))).otherwise(checked)
    return rows.where(checked).withColumn("end", F.col("start") + F.length("what"))


def _candidates(placed: DataFrame) -> DataFrame:
    """Candidates with the signs around them taken off, their pattern, and the kind of a base span that they overlap."""
    head = F.length(F.regexp_extract("what", r"^[^A-Za-z0-9@+(]*", 0))
    tail = F.length(F.regexp_extract("what", r"[^A-Za-z0-9@]*$", 0))
    is_base = F.col("kind").between(0, len(KINDS) - 1)
    rows = placed.where("kind >= 0").select(
        "row", "doc_id", "kind", "what", "left", "right", *(f"run_{k}" for k in RUNS), F.col("start").alias("at"), F.when(is_base, F.col("start")).otherwise(F.col("start") + head).alias("start"), F.when(is_base, F.col("end")).otherwise(F.greatest(F.col("start") + head, F.col("end") - tail)).alias("end")
    )
    inside = Window.partitionBy("row").orderBy("start", "end", "kind")
    past = F.max(F.when(is_base, F.struct("end", "kind", "what", "start", "right"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(is_base, F.struct("start", "kind", "what", "right"))).over(inside.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("past", past).withColumn("ahead", ahead).where(F.col("kind") == len(KINDS))
    in_past, in_ahead = F.col("past.end") > F.col("start"), F.col("ahead.start") < F.col("end")
    seed = F.when(in_past, F.col("past.kind")).when(in_ahead, F.col("ahead.kind"))
    # A seed's instance is the whole base span, which may have several tokens; only the first has the span's words before it.
    rows = rows.where(~F.coalesce(in_past & (F.col("past.start") < F.col("at")), F.lit(False)))
    # A run ends before the next base span.
    free = F.col("ahead.start") - F.col("start")
    shorter = lambda k: F.regexp_extract(F.rtrim(F.left(f"run_{k}", free.cast("int"))), RUNS[k], 1)
    rows = rows.withColumns({f"run_{k}": F.when(free < F.length(f"run_{k}"), shorter(k)).otherwise(F.col(f"run_{k}")) for k in RUNS})
    token = F.regexp_replace("what", r"^[^A-Za-z0-9@+(]*|[^A-Za-z0-9@]*$", "")
    longest = token
    for k in RUNS:
        longest = F.when(F.length(f"run_{k}") > F.length(longest), F.col(f"run_{k}")).otherwise(longest)
    value = F.when(in_past, F.col("past.what")).when(in_ahead, F.col("ahead.what")).otherwise(longest)
    # What stands after a run of several tokens is not looked at.
    after = F.when(in_past, F.col("past.right")).when(in_ahead, F.col("ahead.right")).when(longest == token, F.col("right"))
    before, after = F.split(F.trim(F.lower("left")), r"\s+"), F.split(F.trim(F.lower(after)), r"\s+")
    ends = [F.concat(F.lit("< "), F.element_at(before, -1)), F.concat_ws(" ", F.lit("<<"), F.element_at(before, -2), F.element_at(before, -1)), F.concat(F.lit("> "), F.get(after, F.lit(0))), F.concat_ws(" ", F.lit(">>"), F.get(after, F.lit(0)), F.get(after, F.lit(1)))]
    patterns = F.when(after.isNull(), F.array(*ends[:2])).otherwise(F.array(*ends))
    return rows.select("row", "doc_id", "start", "end", F.lower(value).alias("value"), F.lower(token).alias("token"), *(f"run_{k}" for k in RUNS), patterns.alias("patterns"), seed.alias("seed")).withColumns(_fits()).where("end > start")


def _fits() -> dict[str, Column]:
    """By kind, whether a candidate looks like one."""
    token = lambda k: F.col("token").rlike(SHAPES[k])
    return {f"fits_{k}": token(k) | (F.col(f"run_{k}") != "") if k in RUNS else token(k) for k in KINDS}


def lower_bound(mass: Column, n: Column, z2: float) -> Column:
    """The least share that explains `mass` of n, allowing for a deviation of the square root of z2."""
    p = F.least(mass / n, F.lit(1.0))
    return (p + z2 / (2 * n) - F.sqrt(z2 * p * (1 - p) / n + z2 * z2 / (4 * n * n))) / (1 + z2 / n)


def scored_patterns(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score, support) of the patterns that extract, by rounds over the pattern-instance graph.

    Every distinct (pattern, value) is an edge; sums are pre-aggregated, so frequent patterns are no
    burden. An instance of unknown kind that looks like the kind counts for a half, any other one is
    against it. The more patterns a graph has, the more would look good by chance: the deviation
    that a score allows for grows with the logarithm of their number.
    """
    fits = [f"fits_{k}" for k in KINDS]
    edges = candidates.select(F.explode("patterns").alias("pattern"), "value", "seed", *fits)
    edges = written(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), *(F.max(f).alias(f) for f in fits)))
    known = written(edges.where("seed is not null").groupBy("value").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0)))
    n_patterns = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).count()
    z2 = 2 * math.log(max(n_patterns, 2))
    labels, patterns = known, None
    for _ in range(rounds):
        sums = [F.count("*").alias("n")]
        for k, fit in enumerate(fits):
            mass = F.when(F.col("kind") == k, F.col("score")).when(F.col("kind").isNull() & F.col(fit), F.lit(0.5)).otherwise(0.0)
            sums.append(F.struct(F.lit(k).alias("kind"), F.sum(mass).alias("mass"), F.count_if(F.col("kind") == k).alias("support")).alias(f"k{k}"))
        by_pattern = edges.join(labels, "value", "left").groupBy("pattern").agg(*sums).select("pattern", "n", F.explode(F.array(*(f"k{k}" for k in range(len(KINDS))))).alias("k")).select("pattern", "n", "k.*")
        scored = by_pattern.where(F.col("support") >= SUPPORT).select("pattern", "kind", "support", lower_bound(F.col("mass"), F.col("n"), z2).alias("score"))
        patterns = written(scored.where(F.col("score") >= PATTERN_SCORE))
        guessed = _guessed(edges.join(known.select("value"), "value", "left_anti"), patterns, ["value"])
        best = guessed.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        labels = written(known.unionByName(best))
    return patterns


def _guessed(edges: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, score) of what patterns extract, by the noisy-or of those that agree. What stands after supports what stands before, but names nothing alone."""
    miss = F.exp(F.sum(F.ln(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
    found = edges.join(patterns, "pattern").groupBy(*keys, "kind").agg((1 - miss).alias("score"), F.max(F.col("pattern").startswith("<")).alias("before"))
    return found.where(F.col("before") & (F.col("score") >= INSTANCE_SCORE)).drop("before")


def _added(candidates: DataFrame) -> DataFrame:
    """Spans (row, doc_id, kind, start, end) of unseen identifiers under high-confidence patterns."""
    end = F.lit(None).cast("long")
    for k, name in enumerate(KINDS):
        own = F.when(F.col(f"run_{name}") != "", F.col("start") + F.length(f"run_{name}")).otherwise(F.col("end")) if name in RUNS else F.col("end")
        end = F.when(F.col("kind") == k, F.when(F.col(f"fits_{name}"), own)).otherwise(end)
    unseen = candidates.where("seed is null").withColumn("pattern", F.explode("patterns"))
    found = _guessed(unseen, scored_patterns(candidates), ["row", "start"])
    found = candidates.join(found, ["row", "start"]).withColumn("end", end).where("end is not null")
    best = found.groupBy("row", "doc_id", "start").agg(F.max(F.struct("score", "kind", "end")).alias("b")).select("row", "doc_id", "b.kind", "start", "b.end")
    # Tokens within a run may be found by themselves, too: a span begins where the ones before it end.
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    clear = best.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0))).where("end > done")
    return clear.select("row", "doc_id", "kind", F.greatest("start", "done").alias("start"), "end")


def spans(docs: DataFrame, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables (row, doc_id, kind, start, end): base spans, with a row of kind -1 for every row of docs, and added spans.

    numbered: docs has a column `row` that tells rows apart.
    Places count code points, ends exclusive. Null text counts as empty; repeated rows are rows of
    their own; rows without doc_id are searched like others.
    """
    placed = written(_placed(docs, numbered))
    base = placed.where(F.col("kind") < len(KINDS)).select("row", "doc_id", "kind", "start", "end")
    return base, written(_added(written(_candidates(placed))))


def digests(docs: DataFrame) -> DataFrame:
    """For every row: base counts by kind, digest of the base spans, and all spans as text.

    Null text counts as empty; repeated rows, rows that share a doc_id and rows without one are rows
    of their own; an empty table gives no rows.
    """
    base, added = spans(docs)
    rows = base.withColumn("own", F.lit(True)).unionByName(added.withColumn("own", F.lit(False)))
    real = F.col("kind") >= 0
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("kind", "start", F.concat_ws(":", name, "start", "end").alias("text"))
    listed = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda s: s["text"]))
    counts = [F.count_if(F.col("own") & (F.col("kind") == k)).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    found = rows.withColumn("span", F.when(real, span))
    grouped = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, F.collect_list(F.when(F.col("own"), F.col("span"))).alias("base"), F.collect_list("span").alias("all"))
    return grouped.select("doc_id", *(f"n_{n}" for n in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def clear(rows: DataFrame) -> DataFrame:
    """Spans (row, start, end, kind) as disjoint ones: what overlaps is one span, of the kind that begins first."""
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    done = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("start") >= done, F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "end", "kind"))["kind"].alias("kind"))


def masked(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """docs with personal data in `text` replaced by its kind.

    Null text stays null and empty text empty. Rows are told apart by their place, so rows that share a doc_id, or have
    none, are masked each by its own spans. Other columns stay as they are, whatever their names.
    """
    row, own = free_name(docs, "row"), free_name(docs, "spans")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    base, added = spans(numbered.select(F.col(row).alias("row"), "doc_id", "text"), numbered=True)
    found = clear(base.where("kind >= 0").unionByName(added).select("row", "start", "end", "kind"))
    mine = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(own)).withColumnRenamed("row", row)
    marks = F.array(*(F.lit(mark.format(n.upper())) for n in KINDS))
    # Pieces between spans and marks, joined once: the end of a span is where the next piece begins.
    cut = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(own, lambda s: s["end"].cast("long")))
    pieces = F.zip_with(ends, own, lambda a, s: F.when(s.isNull(), cut(a, F.length("text"))).otherwise(F.concat(cut(a, s["start"]), F.element_at(marks, s["kind"] + 1))))
    text = F.when(F.col(own).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    return numbered.join(mine, row, "left").withColumn("text", text).select(*(quoted(c) for c in docs.columns))
