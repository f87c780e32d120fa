"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed byte n-grams (lengths 2 to 4, within letters), scaled to length one.  Each
language has several centroids, found by spherical k-means over a bounded sample of its labelled texts; a text takes the
language of the centroid with the largest cosine, and is rejected when that cosine falls below a floor learned from
labelled texts of similar length.  Document frequencies cover every labelled text, not the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelrd.llm.common import blocks, flat_text, map_arrow

#: Hashed n-gram terms; labelled texts per language for the centroids; centroids per language.
DIMENSIONS, SAMPLE, CENTROIDS = 8192, 800, 4
#: A text is rejected below this part of the smallest cosine that labelled texts of its length class have (share 0.002 left out).
FLOOR_PART, FLOOR_SHARE = 0.5, 0.002
LETTER = re.compile(r"[^\W\d_]")

#: ASCII letters are lowered, bytes above 127 stay, all others become a space.
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of a row may not be learned: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x DIMENSIONS counts of the n-grams of each row."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, DIMENSIONS), dtype=np.float32)
    folded = _FOLD[data]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * DIMENSIONS
    counts = np.zeros(n * DIMENSIONS, dtype=np.float32)
    gram = folded.copy()
    for k in (2, 3, 4):
        if len(data) < k:
            break
        gram = gram[:-1] * np.uint32(257) + folded[k - 1 :]
        inside = (row[: len(gram)] == row[k - 1 :]) & ~((folded[: len(gram)] == 32) & (folded[k - 1 :] == 32))
        slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
        counts += np.bincount((row[: len(gram)] + slot)[inside], minlength=n * DIMENSIONS).astype(np.float32)
    return counts.reshape(n, DIMENSIONS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def length_class(offsets: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(np.diff(offsets), 1)).astype(np.int64)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k unit centroids; starts from the vector farthest from those chosen, so reruns agree."""
    mean = v.sum(axis=0)
    centres = [v[int(np.argmax(v @ mean))]]
    for _ in range(1, min(k, len(v))):
        nearest = np.max(v @ np.array(centres).T, axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centres.append(v[int(np.argmin(nearest))])
    centres = np.array(centres)
    for _ in range(rounds):
        of = np.argmax(v @ centres.T, axis=1)
        sums = np.array([v[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


@dataclass
class LanguageModel:
    """A fitted classifier: plain arrays of bounded size (languages x CENTROIDS x DIMENSIONS)."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    floors: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine and whether it is rejected, for each row."""
        cosines = unit_vectors(term_counts(data, offsets), self.idf) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        cosine = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return self.of[best], cosine, cosine < self.floors[np.minimum(length_class(offsets), len(self.floors) - 1)]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each term occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            data, offsets = flat_text(batch.column(0))
            for i, j in blocks(offsets, 1 << 19):
                for a in range(i, j, 256):
                    b = min(a + 256, j)
                    found += (term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) > 0).sum(axis=0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMENSIONS), -1)), pa.array(np.append(found, rows))], names=["term", "n"])

    got = map_arrow(docs.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 rows
    n = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in got:
        n[r["term"]] = r["n"]
    return n[:-1], int(n[-1])


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel | None:
    """Fit on all rows of (doc_id, text, lang) with both text and lang; None without any.

    `sample` bounds the labelled texts of a language that the centroids are made from (chosen by a hash).
    """
    labelled = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    rate = F.element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, sample / v)))), F.col("lang"))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < rate * (1 << 20))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"]).head(2 * sample)
        data, offsets = flat_text(pa.array(pdf.text))
        v = unit_vectors(term_counts(data, offsets), idf)
        full = np.abs(v).sum(axis=1) > 0
        if not full.any():
            return pd.DataFrame({"lang": [], "kind": [], "value": []})
        centres = spherical_kmeans(v[full], centroids)
        near = np.max(v[full] @ centres.T, axis=1)
        out = [(pdf.lang.iloc[0], -1, c.astype(np.float64)) for c in centres]
        classes = length_class(offsets)[full]
        out += [(pdf.lang.iloc[0], int(k), near[classes == k].astype(np.float64)) for k in np.unique(classes)]
        return pd.DataFrame(out, columns=["lang", "kind", "value"])

    got = chosen.groupBy("lang").applyInPandas(cluster, "lang string, kind int, value array<double>").collect()  # bounded: languages x (CENTROIDS x DIMENSIONS + 2 SAMPLE)
    mine = sorted((r for r in got if r["kind"] < 0), key=lambda r: (r["lang"], r["value"]))
    if not mine:
        return None
    langs = sorted({r["lang"] for r in mine})
    near: dict[int, list[float]] = {}
    for r in got:
        if r["kind"] >= 0:
            near.setdefault(r["kind"], []).extend(r["value"])
    floors, low = np.zeros(40), 0.0
    for k in range(40):  # a longer text is never held to less
        low = max(low, FLOOR_PART * float(np.quantile(near[k], FLOOR_SHARE))) if len(near.get(k, ())) >= 20 else low
        floors[k] = low
    return LanguageModel(langs, idf, np.array([r["value"] for r in mine], dtype=np.float32), np.array([langs.index(r["lang"]) for r in mine]), floors)


def identify(docs: DataFrame, model: LanguageModel | None, unknown: str = "und") -> DataFrame:
    """`docs` with _lang_pred (string), _lang_score (0 to 1) and _lang_rejected.

    A null text, and one without any letter, is `unknown` with score 0 and rejected, as is every text without a model.
    Equal cosines go to the language that comes first.  Rows are read one by one, so repeated rows, null ids and very long
    texts need nothing else.  All columns of `docs` stay, but for those named as the three new ones; an empty table gives no rows.
    """
    docs = docs.drop("_lang_pred", "_lang_score", "_lang_rejected")
    n = len(docs.columns)
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(at))
            lang, score, rejected = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            letters = np.array([bool(x) and LETTER.search(x) is not None for x in batch.column(at).to_pylist()], dtype=bool)
            if model is not None:
                for i, j in blocks(offsets, 1 << 19):
                    for a in range(i, j, 256):
                        b = min(a + 256, j)
                        lang[a:b], score[a:b], rejected[a:b] = model.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names = np.array(model.langs, dtype=object)[lang]
            else:
                letters[:] = False
                names = np.full(batch.num_rows, unknown, dtype=object)
            names[~letters], score[~letters], rejected[~letters] = unknown, 0.0, True
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)] + [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=batch.schema.names[:n] + ["_lang_pred", "_lang_score", "_lang_rejected"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _lang_pred string, _lang_score double, _lang_rejected boolean"
    return map_arrow(docs, predict, ddl)


def op8_language_id(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all rows; digest of `identify`."""
    model = fit(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_lang_rejected").alias("rejected"))
