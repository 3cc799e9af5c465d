"""Quality rules: base counts of a text, and robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For each group of texts a minimum-covariance-
determinant estimate is made from all of its rows: from several fixed starts the half of the rows that lie
nearest is averaged again and again (concentration steps), until no group's determinant falls any
more; of a group's starts the one with the least determinant wins, and at last all rows within the reach of
nearly all normal ones are averaged (reweighting). Every step is one aggregation over the groups, and
junk of up to nearly half of a group's rows has no part in its estimate. A group is a language and source. Its
estimate is drawn towards that of its language, and that towards the one of all rows, the more the
fewer rows it has, so no number of rows changes how a group is judged. Rows whose Mahalanobis distance from their
group's estimate is beyond the cut are rejected.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.bpe import text_batches
from emberlog.llm.common import written

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of rows in the robust core; most concentration steps, and the fall of a log determinant worth another; share of normal rows that reweighting takes.
CORE, STEPS, FALL, REWEIGHTED = 0.5, 10, 1e-3, 0.975
#: Rows at which a group's own estimate weighs as much as the one it is drawn to.
SHRINK = 80.0
#: The cut on the squared distance. Normal vectors of six statistics would pass 22.5 once in a thousand, but shares of repeats and symbols
#: have long tails in prose: documents a few of whose lines repeat reach 40. Each statistic alone still passes this cut, see FEATURES.
CUT = 60.0
#: Widths of the bins in which statistics and (logarithms of) distances are counted for medians and cores: counts give the same however rows are dealt.
STATISTIC_BIN, DISTANCE_BIN = 0.001, 0.01
#: Groups whose estimates (some kilobytes each) are broadcast; beyond, parts into which a group is spread.
BROADCAST_GROUPS, SALTS = 5_000, 32
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_GAPS = " \t\n\v\f\r"
_LETTERS = re.compile(r"[A-Z]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

STATISTICS = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics with their least standard deviations: groups whose rows are all alike must not reject what differs by a hair.
FEATURES = {"x_length": 0.08, "x_symbols": 0.03, "x_lines": 0.085, "x_repeats": 0.065, "x_upper": 0.06, "x_same": 0.06}
VECTOR = list(FEATURES)
PAIRS = [(a, b) for k, a in enumerate(VECTOR) for b in VECTOR[k:]]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for k in range(window):
            key = key * _FACTOR + own[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_same (words equal to the one before) of a whole text."""
    if not text:
        return (0,) * 8
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _GAPS))
    lines = [x for x in text.split("\n") if x.strip(_GAPS)]
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(_LETTERS.findall(text))
    same = sum(map(operator.eq, words, words[1:]))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, same


COUNTS = ["n_words", *STATISTICS, "n_lines", "n_upper", "n_same"]


def measured(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, source and the counts of every row; null text has no words."""
    rows = docs.select(key, "lang", "source", "text")

    def counted(batches):
        for batch in text_batches(batches):
            found = list(zip(*map(statistics, batch.column(3).to_pylist()), strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in found)], [key, "lang", "source", *COUNTS])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(counted, f"{key} {kinds[key]}, lang {kinds['lang']}, source {kinds['source']}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> dict[str, Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "x_length": F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": share("n_symbols", "word_chars"),
        "x_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
        "x_upper": share("n_upper", "word_chars"),
        "x_same": share("n_same", "n_words"),
    }


def _with(rows: DataFrame, params: DataFrame, on: list[str], groups: int, how: str = "inner") -> DataFrame:
    """Rows with what belongs to their group: broadcast for a counted, bounded number of groups, else spread by a salt."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(params), on, how)
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(*VECTOR), F.lit(SALTS))).join(salted, [*on, "_salt"], how).drop("_salt")


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds the row's groups: language with source, and language."""
    name = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    return rows.withColumns({"g_fine": F.concat_ws("\u0000", F.lit("source"), name("lang"), name("source")), "g_lang": F.concat_ws("\u0000", F.lit("lang"), name("lang"))})


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, bin): the quantile of bins that occur n times."""
    return counts.groupBy(*keys).agg(F.percentile("bin", share, F.col("n")).alias("bin"))


def _medians(rows: DataFrame, values: dict[str, Column], share: float = 0.5) -> DataFrame:
    """g and a quantile of each of the values."""
    binned = [F.struct(F.lit(name).alias("name"), F.floor(v / STATISTIC_BIN).alias("bin")) for name, v in values.items()]
    counts = rows.select("g", F.explode(F.array(*binned)).alias("v")).groupBy("g", "v.name", "v.bin").agg(F.count("*").alias("n"))
    found = _quantile(counts, ["g", "name"], share)
    return found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, (F.col("bin") + 0.5) * STATISTIC_BIN)).alias(name) for name in values))


def _distance(prefix: str = "") -> Column:
    """The squared distance in the frame of a group: differences times the inverse covariance."""
    d = {x: F.col(x) - F.col(f"c_{x}") for x in VECTOR}
    total = F.lit(0.0)
    for a, b in PAIRS:
        total = total + d[a] * d[b] * F.col(f"p_{a}_{b}") * (1.0 if a == b else 2.0)
    return total


_FRAME = [f"c_{x}" for x in VECTOR] + [f"s_{a}_{b}" for a, b in PAIRS] + [f"p_{a}_{b}" for a, b in PAIRS]
_FLOOR = np.diag([v**2 for v in FEATURES.values()])


def _square(row: dict, prefix: str) -> np.ndarray:
    out = np.zeros((len(VECTOR),) * 2)
    for a, b in PAIRS:
        i, j = VECTOR.index(a), VECTOR.index(b)
        out[i, j] = out[j, i] = row[f"{prefix}_{a}_{b}"]
    return out


def _frame(centre: np.ndarray, cov: np.ndarray) -> list[float]:
    """Centre, covariance and its inverse, in the order of _FRAME."""
    inverse = np.linalg.inv(cov)
    upper = lambda m: [float(m[VECTOR.index(a), VECTOR.index(b)]) for a, b in PAIRS]
    return [*centre.tolist(), *upper(cov), *upper(inverse)]


def _by_group(rows: DataFrame, keys: dict[str, str], made, more: dict[str, str] | None = None) -> DataFrame:
    """made(row) for each row of a group: values of the keys, of _FRAME and of `more`."""
    kinds = {**keys, **dict.fromkeys(_FRAME, "double"), **(more or {})}
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            found = [made(row) for row in batch.to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*found, strict=True), kinds.values(), strict=True)], list(kinds))

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def _inverted(moments: DataFrame) -> DataFrame:
    """The frame of a group and start from mean products, and the logarithm of its determinant."""

    def made(row):
        centre = np.array([row[f"m_{x}"] for x in VECTOR])
        values, vectors = np.linalg.eigh(_square(row, "s") - np.outer(centre, centre))
        cov = (vectors * np.maximum(values, 0)) @ vectors.T * row["scale"] + _FLOOR
        return row["g"], row["start"], *_frame(centre, cov), float(np.linalg.slogdet(cov)[1])

    return _by_group(moments, {"g": "string", "start": "int"}, made, {"logdet": "double"})


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    aggs = [F.avg(x).alias(f"m_{x}") for x in VECTOR] + [F.avg(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in PAIRS]
    return rows.groupBy("g", "start").agg(*aggs, F.lit(scale).alias("scale"))


def _starts(own: DataFrame, groups: int) -> DataFrame:
    """Frames to begin with: the middle with the middle deviations, the first quarter with those (junk raises these statistics), and the middle with the least deviations."""
    value = {x: F.col(x) for x in VECTOR}
    middle, low = written(_medians(own, value)), written(_medians(own, value, 0.25))
    named = lambda df, p: df.withColumnsRenamed({x: f"{p}_{x}" for x in VECTOR})
    spread = _medians(_with(own, named(middle, "c"), ["g"], groups), {x: F.abs(F.col(x) - F.col(f"c_{x}")) for x in VECTOR})
    all_of = named(middle, "mid").join(named(low, "low"), "g").join(named(spread, "dev"), "g")

    def start(k, centre, wide):
        deviation = lambda x: F.lit(FEATURES[x] ** 2) + (F.pow(1.4826 * F.col(f"dev_{x}"), F.lit(2.0)) if wide else F.lit(0.0))
        inverse = [(1 / deviation(a) if a == b else F.lit(0.0)).alias(f"p_{a}_{b}") for a, b in PAIRS]
        return all_of.select("g", F.lit(k).alias("start"), *(F.col(f"{centre}_{x}").alias(f"c_{x}") for x in VECTOR), *inverse)

    return written(start(0, "mid", True).unionByName(start(1, "low", True)).unionByName(start(2, "mid", False)))


def estimates(own: DataFrame, groups: int, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant frame of each group g of `own`."""
    shape, before = _starts(own, groups), None
    for _ in range(steps):
        far = _with(own, shape, ["g"], groups).withColumn("bin", F.floor(F.log1p(_distance()) / DISTANCE_BIN)).select("g", "start", "bin", *VECTOR)
        reach = _quantile(far.groupBy("g", "start", "bin").agg(F.count("*").alias("n")), ["g", "start"], core).withColumnRenamed("bin", "reach")
        # The core's covariance is too small by a factor that holds for normal vectors.
        inner = _with(far, reach, ["g", "start"], groups).where("bin <= reach")
        shape = written(_inverted(_moments(inner, consistency(core, len(VECTOR)))))
        if before is not None:
            fall = shape.join(before, ["g", "start"]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
            if fall is None or fall < FALL:
                break
        before = shape.select("g", "start", F.col("logdet").alias("before"))
    best = shape.groupBy("g").agg(F.min(F.struct("logdet", "start", *_FRAME)).alias("b")).select("g", "b.*")
    near = _with(own, written(best), ["g"], groups).where(_distance() <= quantile(REWEIGHTED, len(VECTOR)))
    return written(_inverted(_moments(near, consistency(REWEIGHTED, len(VECTOR)))))


def _drawn(fine: DataFrame, frames: DataFrame, shrink: float) -> DataFrame:
    """(g_fine, frame): of each group the mixture of its own estimate, its language's and that of all rows."""
    level = lambda p, key: frames.select(F.col("g").alias(key), F.struct(*_FRAME).alias(p))
    sizes = fine.withColumn("n_lang", F.sum("n").over(Window.partitionBy("g_lang")))
    rows = sizes.join(level("f", "g_fine"), "g_fine").join(level("l", "g_lang"), "g_lang").withColumn("g_all", F.lit(ALL)).join(level("a", "g_all"), "g_all")

    def mixed(share, one, other):
        gap = one[0] - other[0]
        return share * one[0] + (1 - share) * other[0], share * one[1] + (1 - share) * other[1] + share * (1 - share) * np.outer(gap, gap)

    def made(row):
        f, l, a = ((np.array([row[k][f"c_{x}"] for x in VECTOR]), _square(row[k], "s")) for k in "fla")  # noqa: E741
        wide = mixed(row["n_lang"] / (row["n_lang"] + shrink), l, a)
        return row["g_fine"], *_frame(*mixed(row["n"] / (row["n"] + shrink), f, wide))

    return _by_group(rows, {"g_fine": "string"}, made)


ALL = "all"


def outliers(rows: DataFrame, core: float = CORE, steps: int = STEPS, shrink: float = SHRINK) -> DataFrame:
    """Adds `distance` (squared, null for rows that are not judged) to rows with a vector, lang, source and a flag `judged`."""
    rows = written(_grouped(rows))
    fine = written(rows.where("judged").groupBy("g_fine", "g_lang").agg(F.count("*").alias("n")))
    groups = 2 * fine.count() + 1
    own = rows.where("judged").select(F.explode(F.array("g_fine", "g_lang", F.lit(ALL))).alias("g"), *VECTOR)
    frames = written(_drawn(fine, estimates(own, groups, core, steps), shrink))
    judged = _with(rows, frames, ["g_fine"], groups, "left").withColumn("distance", F.when(F.col("judged"), _distance()))
    return judged.drop("g_fine", "g_lang", *_FRAME)


def _below(x: float, k: int) -> float:
    """P(chi2(k) <= x) for even k in closed form."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))


def quantile(share: float, p: int) -> float:
    """The quantile of chi2(p), for even p."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _below(mid, p) < share else (low, mid)
    return low


def consistency(core: float, p: int) -> float:
    """core / P(chi2(p + 2) <= q) with q the core quantile of chi2(p), for even p."""
    return core / _below(quantile(core, p), p + 2)


def judge(docs: DataFrame, cut: float = CUT, key: str = "doc_id") -> DataFrame:
    """key, counts, base_failed, distance, kept of every row.

    Rows that fail the base rules are not part of the estimates and not kept. Null text fails; null
    language or source is a group like any other; repeated rows are judged alike. An empty table gives no rows.
    """
    rows = written(measured(docs, key)).withColumns(_vector()).withColumn("base_failed", base_failed()).withColumn("judged", ~F.col("base_failed"))
    found = outliers(rows)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)
    return found.select(key, *COUNTS, "base_failed", "distance", kept.alias("kept"))
