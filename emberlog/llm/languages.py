"""Language identification by the nearest of several centroids per language.

Texts become hashed counts of two- and three-byte n-grams (ASCII lower-cased, other ASCII than letters as
spaces), weighted by TF-IDF and scaled to length one. A bounded sample of labelled rows is grouped
into a few centroids per language by spherical k-means; a text takes the language of the centroid
with the greatest cosine, and is flagged as rejected where that cosine lies below what nearly all
training texts of the language reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.bpe import text_batches

#: Hashed n-gram classes; labelled rows to fit on, per language, at about this number; centroids per language.
CLASSES, SAMPLE_ROWS, CENTROIDS = 1 << 14, 1500, 4
#: Labelled rows to fit on over all languages, at about this number; the share of training texts that may lie beyond the rejection distance.
MOST_ROWS, REJECTED = 60_000, 0.002

_TABLE = np.full(256, 32, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if text else False


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a text with a space at either end."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    out = np.zeros(CLASSES, np.int64)
    for k in range(0, max(1, len(raw) - 2), 1 << 22):  # long texts in parts that overlap by two bytes
        a = _TABLE[raw[k : k + (1 << 22) + 2]].astype(np.uint32)
        with np.errstate(over="ignore"):
            two = a[:-1] * np.uint32(256) + a[1:]
            three = (two[:-1] * np.uint32(256) + a[2:]) * np.uint32(2654435761)
            two = (two + np.uint32(1 << 24)) * np.uint32(2246822519)
        shift = np.uint32(32 - 14)
        out += np.bincount(three >> shift, minlength=CLASSES)
        out += np.bincount(two[: len(three)] >> shift, minlength=CLASSES)
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # a row each, scaled to length one and times idf
    owner: np.ndarray  # of each centroid, the language's place
    least: np.ndarray  # of each language, the cosine below which a text is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, rejected: `und` for texts without a letter and models without a language."""
        if not self.languages or not has_letter(text or ""):
            return "und", 0.0, True
        tf = np.log1p(counts(text)).astype(np.float32)
        weighted = tf * self.idf
        cosines = (self.centroids @ tf) / max(float(np.sqrt(weighted @ weighted)), 1e-12)
        best = int(np.argmax(cosines))
        own = int(self.owner[best])
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[own], score, score < float(self.least[own])


SPREAD = 1 << 30


def _order(by: str) -> Column:
    return F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.lit(SPREAD))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", rows_per_language: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Centroids from a sample of about `rows_per_language` rows of each language, chosen by a hash of `by`.

    With very many languages each has fewer rows, so that a fit looks at about MOST_ROWS, but no
    language is left out: a row of each is always taken. Whole texts count. Rows without text, label or letters are left out;
    no rows give a model without languages.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # A row per label: what a prediction can name at all.
    found = rows.groupBy(lang).agg(F.count("*").alias("n"), F.min(F.when(F.col(text).rlike(r"\p{L}"), _order(by))).alias("least")).collect()
    sizes, least_of = {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found}
    if not sizes:
        return Model((), np.zeros(CLASSES, np.float32), np.zeros((0, CLASSES), np.float32), np.zeros(0, int), np.zeros(0))
    per = min(rows_per_language, max(1, MOST_ROWS // len(sizes)))
    upto = labelled.sparkSession.createDataFrame([(name, max(int(min(1.0, per / n) * SPREAD), 1 + (least_of[name] or 0))) for name, n in sizes.items()], "lang string, upto long")
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), _order(by).alias("place"))
    chosen = rows.join(F.broadcast(upto), "lang").where("place < upto").select("lang", "text")

    def vectors(batches):
        for batch in text_batches(batches):
            found = [counts(t) if has_letter(t) else np.zeros(CLASSES, np.int64) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(v) for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([np.log1p(v[x]).astype("<f4").tobytes() for v, x in zip(found, at, strict=True)], pa.binary())], ["lang", "at", "tf"]
            )

    table = chosen.mapInArrow(vectors, "lang string, at binary, tf binary").toArrow()
    at = [np.frombuffer(x, "<u2") for x in table.column("at").to_pylist()]
    tf = [np.frombuffer(x, "<f4") for x in table.column("tf").to_pylist()]
    label = np.array(table.column("lang").to_pylist())
    seen = np.bincount(np.concatenate(at), minlength=CLASSES) if at else np.zeros(CLASSES)
    idf = (np.log((1 + len(at)) / (1 + seen)) + 1).astype(np.float32)
    names = sorted(n for n in sizes if any((label == n) & np.array([len(x) > 0 for x in at])))
    rows_, owner, least = [], [], []
    for k, name in enumerate(names):
        own = [j for j in np.flatnonzero(label == name) if len(at[j])]
        x = np.zeros((len(own), CLASSES), np.float32)
        for row, j in enumerate(own):
            x[row, at[j]] = tf[j] * idf[at[j]]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = x[np.lexsort((x.sum(axis=1), x @ x.mean(axis=0)))]  # in an order of its own, whatever the order of rows
        c = _clusters(x, min(centroids, len(own)))
        rows_.append(c)
        owner += [k] * len(c)
        least.append(float(np.quantile((x @ c.T).max(axis=1), REJECTED)))
    return Model(tuple(names), idf, (np.concatenate(rows_) * idf).astype(np.float32), np.array(owner), np.array(least)) if names else Model((), idf, np.zeros((0, CLASSES), np.float32), np.zeros(0, int), np.zeros(0))


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from starts spread along the order of the rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def identify(docs: DataFrame, model: Model, key: str = "doc_id", extra: list[Column] | None = None) -> DataFrame:
    """key, extra columns, lang_pred, score, rejected for every row, from its whole text alone.

    Null, empty and letterless texts: `und`, 0, rejected. Equal texts have equal results; of centroids
    at the same distance the language first in order wins. An empty table gives no rows; other
    columns are not looked at.
    """
    rows = docs.select(key, F.col("text"), *(extra or []))
    names = [key, *rows.columns[2:]]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 16 KB for each centroid

    def named(batches):
        for batch in text_batches(batches):
            found = list(zip(*map(shared.value.predict, batch.column(1).to_pylist()), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(named, ", ".join(f"{c} {kinds[c]}" for c in names) + ", lang_pred string, score double, rejected boolean")
