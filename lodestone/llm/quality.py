"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are hashed into ``BITS`` bits: its words, its word pairs, the shapes of words and of word pairs
(runs of capitals, small letters, digits and of each other sign), and whether a word repeats the one before it. A
feature counts once, weighed by one plus the logarithm of its count, and a text's features have length one. A score is
the logistic of a sparse dot product, shifted so that the best cut on labelled rows kept aside lies at 0.7.

Learning reads at most ``MAX_LABELLED`` labelled rows and ``MAX_BYTES`` of their text, the first by a hash of their
id, in one task; the model is an array of 2**BITS floats. Scoring reads every whole text.

Defined cases: null and empty texts have no features and get the score of the intercept alone; null ids are never held
out; labels that are null take no part, and of several labels of an id the largest holds; with no labels, or those of
one class only, every score is the share of label 1 among them (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as T

BITS = 18
MAX_LABELLED = 10_000
MAX_BYTES = 128 << 20
EPOCHS = 3
CUT = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:256] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: its classes of signs, runs told once."""
    code = _SHAPE[buf]
    kept = np.ones(len(code), dtype=bool)
    kept[1:] = code[1:] != code[:-1]
    kept[starts] = True
    place = np.concatenate(([0], np.cumsum(kept)))
    return T.word_hashes(code[kept], place[starts], place[ends])


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, index, value): of row i the features are those from bounds[i] to bounds[i + 1]."""
    starts, ends, bounds = T.word_spans(buf, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    words = T.word_hashes(T.LOWER[buf], starts, ends)
    shapes = _shapes(buf, starts, ends) ^ np.uint64(0x5851F42D4C957F2D)
    parts, rows = [words, shapes], [row, row]
    for of in (words, shapes):
        h, at = T.gram_hashes(of, bounds, 2)
        parts.append(h)
        rows.append(row[at])
    same = at[words[at] == words[at + 1]]
    parts.append(np.full(len(same), 0x1234567890ABCDEF, np.uint64))
    rows.append(row[same])
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(parts) >> np.uint64(64 - BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    of_row = (key >> np.uint64(BITS)).astype(np.int64)
    value = 1.0 + np.log(n)
    norm = np.sqrt(np.bincount(of_row, value**2, len(off) - 1))
    value /= norm[of_row]
    return np.searchsorted(of_row, np.arange(len(off))), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), value


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def best_cut(logit: np.ndarray, label: np.ndarray) -> float:
    """The cut of least mean error of the two classes, in the middle of the gap that it lies in."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    miss = np.concatenate(([0], np.cumsum(y))) / max(y.sum(), 1) + (np.sum(1 - y) - np.concatenate(([0], np.cumsum(1 - y)))) / max(np.sum(1 - y), 1)
    best = np.flatnonzero(miss <= miss.min() + 1e-9)
    edge = np.concatenate(([x[0] - 1.0], (x[1:] + x[:-1]) / 2, [x[-1] + 1.0]))
    return float(np.median(edge[best]))


def train(examples: Iterator[tuple[np.ndarray, np.ndarray, int, bool]]) -> np.ndarray:
    """Weights, then intercept, of (index, value, label, kept aside) examples; one pass over them is an epoch."""
    seen = list(examples)
    w, z, n = (np.zeros((1 << BITS) + 1) for _ in range(3))
    label = np.array([y for _, _, y, _ in seen], np.int64)
    aside = np.array([a for *_, a in seen], dtype=bool)
    if len(set(label.tolist())) < 2:
        w[-1] = 0.0 if not len(label) else np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6))
        return w
    share = label.mean()
    weigh = {1: 0.5 / share, 0: 0.5 / (1 - share)}

    def logit(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        at, x = np.append(index, 1 << BITS), np.append(value, 1.0)
        zz = z[at]
        now = np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
        return at, now, x

    for _ in range(EPOCHS):
        for index, value, y, kept in seen:
            if kept:
                continue
            at, now, x = logit(index, value)
            g = (float(_logistic(now @ x)) - y) * weigh[y] * x
            before = n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / ALPHA * now
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    use = aside if len(set(label[aside].tolist())) == 2 else ~aside
    x = np.array([w[i] @ v + w[-1] for (i, v, _, _), u in zip(seen, use, strict=True) if u])
    w[-1] += np.log(CUT / (1 - CUT)) - best_cut(x, label[use])
    return w


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, text, lang, label, place) of at most ``most`` labelled rows outside the fold, the first by a hash of the id. The ids are at most that many, so they are broadcast."""
    learn = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    learn = learn.withColumn("place", F.xxhash64("doc_id", F.lit(5))).orderBy("place").limit(most)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).join(F.broadcast(learn), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, label_col: str = "quality") -> np.ndarray:
    rows = labelled(docs, labels, label_col, folds, fold, MAX_LABELLED)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
            left = MAX_BYTES
            for batch in batches:
                label, place = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for row, end, buf, off in T.text_slices(batch.column(0)):
                    left -= len(buf)
                    if left < 0:
                        return
                    bounds, index, value = features(buf, off)
                    for i in range(row, end):
                        s = slice(bounds[i - row], bounds[i - row + 1])
                        yield index[s].astype(np.int32), value[s].astype(np.float32), label[i], place[i] % 5 == 0

        yield pa.RecordBatch.from_arrays([pa.array([train(examples()).astype(np.float32).tobytes()], pa.binary())], ["model"])

    one = rows.select("text", "label", "place").repartitionByRange(1, "place").sortWithinPartitions("place", "text")
    found = one.mapInArrow(fit, "model binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, folds: int = 4, fold: int = 2, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = held.value
        out = np.zeros(batch.num_rows)
        for row, end, buf, off in T.text_slices(batch.column(1)):
            bounds, index, value = features(buf, off)
            # each row is summed by itself, so that its score does not depend on its neighbours
            total, has = np.zeros(end - row), np.flatnonzero(np.diff(bounds))
            if len(has):
                total[has] = np.add.reduceat(w[index].astype(np.float64) * value, np.asarray(bounds)[has])
            out[row:end] = _logistic(total + w[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from scores(batch)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(over, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
