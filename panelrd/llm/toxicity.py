"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (letters only, ASCII lowered) and their first 4, 5 and 6 bytes, hashed to 62 bits.  The score of the
set of a text's known terms is logistic(bias + sum of weights + sum over pairs of <factors, factors>): the pair part
learns combinations, such as an insult next to a group's name, that a sum of weights cannot tell from either alone.  Only terms whose presence differs between the classes by more
than chance are kept, so that the many neutral words of a long text do not add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import RangeHash, blocks, byte_values, flat_text, map_arrow
from panelrd.llm.langid import held_out

#: Labelled texts of each class to fit on at most; factors of a term; texts of the sample a term must occur in.
SAMPLE, FACTORS, LEAST_TEXTS = 3000, 4, 3
#: Standard errors by which a term's presence must differ between the classes, or by which two terms must change each other's
#: effect; part of a class's texts that hold a term whose pairs are looked at; texts in each cell of a pair.
LEAST_Z, LEAST_PAIR_Z, PAIR_SHARE, PAIR_TEXTS = 5.0, 6.0, 0.05, 20
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.1, 2e-3
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term, repeats included."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = _FOLD[data]
    letter = folded != 32
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= letter[inner]
    end[inner - 1] |= letter[inner - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, begin, side="right") - 1
    ranges = RangeHash(byte_values(folded))
    rows, terms = [row], [ranges(begin, end) >> np.uint64(2)]
    for k in PREFIXES:
        long = end - begin > k
        rows.append(row[long])
        terms.append(ranges(begin[long], begin[long] + k) >> np.uint64(2))
    return np.concatenate(rows), np.concatenate(terms).view(np.int64)


@dataclass
class FactorizationMachine:
    """Known terms (sorted hashes) with weights and factors; bounded by the sample that it was fitted on."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def known(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different known terms of each row, in the order of rows."""
        if not len(self.terms) or not len(term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        both = np.unique(row[hit].astype(np.int64) * len(self.terms) + at[hit])
        return both // len(self.terms), both % len(self.terms)

    def margins(self, n: int, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[at]
        sums = np.stack([np.bincount(row, v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(row, (v * v).sum(axis=1), minlength=n)
        return self.bias + np.bincount(row, self.weights[at], minlength=n) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        return logistic(self.margins(n, *self.known(*term_hashes(data, offsets)))[0])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def interacting(at: np.ndarray, row: np.ndarray, often: np.ndarray, size: int, labels: np.ndarray, block: int = 256) -> np.ndarray:
    """Places in `often` of terms that change another's effect: p(both) - p(one) - p(other) + p(neither) is far from 0.

    A term that says nothing by itself, such as a group's name, is kept for its pairs.  Blocks of terms are compared with all
    others, so memory stays small; p is the part of toxic texts in a cell, smoothed by one text of each class.
    """
    place = np.full(size, -1)
    place[often] = np.arange(len(often))
    hit = place[at] >= 0
    has = np.zeros((len(labels), len(often)), dtype=np.float32)
    has[row[hit], place[at[hit]]] = 1
    n, y, found = len(labels), labels.astype(np.float32), np.zeros(len(often), dtype=bool)
    texts, toxic = has.sum(axis=0), y @ has
    for i in range(0, len(often), block):
        mine = has[:, i : i + block]
        both, both_toxic = mine.T @ has, (mine * y[:, None]).T @ has
        a, a_toxic = texts[i : i + block, None], toxic[i : i + block, None]
        cells = ((both, both_toxic), (a - both, a_toxic - both_toxic), (texts - both, toxic - both_toxic), (n - a - texts + both, y.sum() - a_toxic - toxic + both_toxic))
        effect, error, least = 0.0, 0.0, np.inf
        for sign, (m, k) in zip((1, -1, -1, 1), cells):
            p = (k + 1) / (m + 2)
            effect, error, least = effect + sign * p, error + p * (1 - p) / (m + 2), np.minimum(least, m)
        found[i : i + block] |= ((least >= PAIR_TEXTS) & (np.abs(effect) >= LEAST_PAIR_Z * np.sqrt(error))).any(axis=1)
    return found


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """Weighted logistic loss by AdaGrad over small batches; `rows` hold the different term hashes of each text."""
    if not rows:
        return FactorizationMachine(np.zeros(0, np.int64), -5.0, np.zeros(0), np.zeros((0, FACTORS)))
    every, at, texts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    toxic = np.bincount(at, np.repeat(labels, [len(r) for r in rows]), minlength=len(every))
    part, n = float(labels.mean()), len(labels)
    z = (toxic - texts * part) / np.sqrt(texts * max(part * (1 - part), 1e-9) * (1 - texts / n) + 1e-9)
    alone = (texts >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z)
    often = np.flatnonzero((toxic >= PAIR_SHARE * max(labels.sum(), 1)) | (texts - toxic >= PAIR_SHARE * max((1 - labels).sum(), 1)))
    alone[often[interacting(at, np.repeat(np.arange(n), [len(r) for r in rows]), often, len(every), labels)]] = True
    terms = every[alone]
    rng = np.random.default_rng(seed)
    share = float(np.average(labels, weights=weights))
    model = FactorizationMachine(terms, float(np.log(max(share, 1e-4) / max(1 - share, 1e-4))), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)))
    if not len(terms):
        return model
    known = []
    for r in rows:
        at = np.minimum(np.searchsorted(terms, r), len(terms) - 1)
        known.append(at[terms[at] == r])
    seen_w, seen_v = np.full(len(terms), 1e-3), np.full((len(terms), FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            at = np.concatenate([known[k] for k in part])
            row = np.repeat(np.arange(len(part)), [len(known[k]) for k in part])
            margin, sums = model.margins(len(part), row, at)
            slope = (logistic(margin) - labels[part]) * weights[part] / BATCH
            model.bias -= 0.02 * float(slope.sum())
            touched, place = np.unique(at, return_inverse=True)
            gw = np.bincount(place, slope[row], minlength=len(touched)) + DECAY / BATCH * model.weights[touched]
            # the gradient of a factor: the sum of the text's other terms' factors
            pair = slope[row][:, None] * (sums[row] - model.factors[at])
            gv = np.stack([np.bincount(place, pair[:, f], minlength=len(touched)) for f in range(FACTORS)], axis=1) + 10 * DECAY / BATCH * model.factors[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            model.weights[touched] -= RATE * gw / np.sqrt(seen_w[touched])
            model.factors[touched] -= 0.2 * RATE * gv / np.sqrt(seen_v[touched])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on labelled documents: `docs` (doc_id, text), `labels` (doc_id, toxic).

    `sample` bounds the labelled documents of each class (the first by a hash of the id); weights restore the classes'
    shares.  A document labelled twice counts as toxic if any label says so; null labels and ids are left out.
    """
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # a row per class
    chosen = None
    for k in sizes:
        part = marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit_machine([], np.zeros(0), np.zeros(0))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            out = []
            for r in range(batch.num_rows):
                out.append(np.unique(term_hashes(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary()), batch.column(2)], names=["doc_id", "terms", "toxic"])

    # at most 2 x sample rows of labels, so the broadcast is bounded and the texts are not shuffled
    used = map_arrow(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "toxic"), terms, "doc_id long, terms binary, toxic int")
    got = sorted(used.collect(), key=lambda r: (r["doc_id"], r["terms"]))  # different terms of at most 2 x sample texts
    rows = [np.frombuffer(r["terms"], dtype=np.int64) for r in got]
    y = np.array([r["toxic"] for r in got], dtype=np.float64)
    have = {k: max(1, int((y == k).sum())) for k in sizes}
    total = sum(sizes.values())
    weights = np.array([sizes[int(k)] / have[int(k)] for k in y]) * (len(y) / total)
    return fit_machine(rows, y, weights)


def score(docs: DataFrame, model: FactorizationMachine, column: str = "_toxicity") -> DataFrame:
    """`docs` with the toxicity of `text` (0 to 1).  Null and empty texts get the score of no terms.

    Each row is scored by its text alone: repeated rows alike, null ids and very long texts as any.  All columns of `docs` stay,
    but for one named as the new one; an empty table gives no rows.
    """
    docs = docs.drop(column)
    n, at = len(docs.columns), docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(at))
            out = np.zeros(batch.num_rows)
            for i, j in blocks(offsets, 1 << 19):
                out[i:j] = model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)] + [pa.array(out)], names=batch.schema.names[:n] + [column])

    return map_arrow(docs, predict, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {column} double")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels of rows that are not held out, score every document."""
    model = fit(docs, labels.filter(~held_out()))
    found = score(docs.select("doc_id", "text", held_out().alias("held_out")), model, "score")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
