"""Toxicity classifier: a convolutional network on hashed word embeddings, trained in numpy.

A word (small letters, signs at its ends stripped) and its beginnings of the lengths in ``STEMS`` (in bytes) are hashed,
and the embedding of the word is the sum of theirs, so that endings not seen before keep the meaning of a stem. Of the
hashes that at least two labelled texts hold, the ``ROWS`` that part the classes best have an embedding of ``DIM``
numbers, all others count zero. Filters of each width in ``WIDTHS`` slide over the words, the largest value of each
filter in the text is kept (max pooling over the whole text) and a logistic layer gives the score. One embedding
coordinate starts from the log odds of the hash among the labelled texts, the others at random. Scores are shifted so that the best cut on labelled rows kept aside lies at
0.7; for decisions a threshold for each language
is calibrated on the logits of those rows too, drawn towards the common one where a language has few (``lang`` is not
seen by the score).

Learning reads at most ``MAX_LABELLED`` labelled rows and ``MAX_BYTES`` of their text, the first by a hash of their id,
in one task; the model has a fixed size of a few megabytes. Scoring reads every whole text.

Defined cases: null and empty texts have no words and get the score of empty pools; null ids are never held out; null
labels take no part, of several labels of an id the largest holds; repeated rows are scored each; other columns play no
part; an empty table gives no rows; with no labels or one class only every score is the
share of label 1 (0.5 without any); languages that the labels lack, and null, use the common threshold.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm import text as T
from lodestone.llm.frames import freed, fresh
from lodestone.llm.quality import best_cut, held_out, labelled

BITS = 22
CHECK_BITS = 8
STEMS = (4, 5, 6)
ROWS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 6
#: Small sets of labels are gone over more often, up to this many updates (and five times the epochs).
STEPS = 1200
BATCH = 48
RATE = 0.05
CUT = 0.7
MAX_LABELLED = 12_000
MAX_BYTES = 48 << 20
#: Rows kept aside of a language and class that its own threshold needs, and those at which it counts as much as the common one.
LEAST, POOLED = 3, 20

_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of hash codes of each word (its own and its stems'), and for each row boundary the number of words before it."""
    starts, ends, bounds = T.word_spans(buf, off)
    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live := live[(ends[live] - starts[live] > 1) & _SIGN[buf[ends[live] - 1]]]):
        ends[live] -= 1
    live = np.arange(len(starts))
    while len(live := live[(ends[live] - starts[live] > 1) & _SIGN[buf[starts[live]]]]):
        starts[live] += 1
    hashes = T.span_hashes(buf, starts, [ends, *(np.minimum(ends, starts + k) for k in STEMS)])
    codes = [((h ^ np.uint64(i << 50)) >> np.uint64(64 - BITS - CHECK_BITS)).astype(np.int32) for i, h in enumerate(hashes)]
    return np.stack(codes, axis=1), bounds


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


class Network:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.codes = np.zeros(0, np.int32)
        self.E = np.zeros((1, DIM), np.float32)
        self.random = r
        self.W = {w: r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.W[w][:, 0, :] = np.abs(self.W[w][:, 0, :]) + 0.3
        self.b = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.bias = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def pack(self) -> bytes:
        names = {"codes": self.codes, "E": self.E, "out": self.out, "rest": np.array([self.bias, self.scale, self.shift])}
        names |= {f"W{w}": self.W[w] for w in WIDTHS} | {f"b{w}": self.b[w] for w in WIDTHS}
        names |= {"langs": np.array(list(self.thresholds), dtype="U32"), "cuts": np.array(list(self.thresholds.values()))}
        np.savez(to := io.BytesIO(), **names)
        return to.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> Network:
        net, x = cls.__new__(cls), np.load(io.BytesIO(packed))
        net.codes, net.E, net.out = x["codes"], x["E"], x["out"]
        net.bias, net.scale, net.shift = (float(v) for v in x["rest"])
        net.W, net.b = ({w: x[f"{k}{w}"] for w in WIDTHS} for k in "Wb")
        net.thresholds = dict(zip(x["langs"].tolist(), x["cuts"].tolist(), strict=True))
        net.index()
        return net

    def index(self) -> None:
        """Row 0 of E stays zero; code i has row i + 1."""
        self.row = np.zeros(1 << BITS, np.int32)
        self.row[self.codes >> CHECK_BITS] = np.arange(1, len(self.codes) + 1)
        self.check = np.concatenate(([-1], self.codes & ((1 << CHECK_BITS) - 1))).astype(np.int32)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        found = self.row[codes >> CHECK_BITS]
        found[self.check[found] != (codes & ((1 << CHECK_BITS) - 1))] = 0
        return found

    def _pool(self, response: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
        """Largest response of each filter in each row; 0 where a row has fewer words than the filter is wide."""
        n = len(bounds) - 1
        pooled = np.zeros((n, FILTERS), np.float32)
        if len(response) == 0:
            return pooled
        for i in range(1, width):  # windows that reach into the next row
            at = bounds[1:] - i
            response[at[(at >= 0) & (at < len(response))]] = 0
        full = np.flatnonzero((np.diff(bounds) >= width) & (bounds[:-1] < len(response)))
        if len(full):
            # rows between two full rows hold too few words, and all their windows count 0
            pooled[full] = np.maximum(np.maximum.reduceat(response, bounds[full], axis=0), 0)
        return pooled

    def logits(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = self.rows(codes)
        x = self.E[rows[:, 0]]
        for i in range(1, rows.shape[1]):
            x += self.E[rows[:, i]]
        pools = []
        for w in WIDTHS:
            n = len(x) - w + 1
            response = np.zeros((0, FILTERS), np.float32)
            if n > 0:
                response = x[:n] @ self.W[w][0]
                for i in range(1, w):
                    response += x[i : i + n] @ self.W[w][i]
                response += self.b[w]
            pools.append(self._pool(response, bounds, w))
        return np.concatenate(pools, axis=1) @ self.out + self.bias

    def _vocabulary(self, texts: list[np.ndarray], label: np.ndarray) -> None:
        """Choose the codes with a row, and start one coordinate at their log odds."""
        total = {y: max(int(np.sum(label == y)), 1) for y in (0, 1)}
        kept = [np.unique(t) for t in texts]
        codes, where = np.unique(np.concatenate(kept), return_inverse=True)
        y = np.repeat(label, [len(k) for k in kept])
        held = {1: np.bincount(where, y, len(codes)), 0: np.bincount(where, 1 - y, len(codes))}
        odds = np.log((held[1] + 0.5) / total[1]) - np.log((held[0] + 0.5) / total[0])
        odds[held[0] + held[1] < 2] = 0
        best = np.argsort(-np.abs(odds), kind="stable")[:ROWS]
        best = best[odds[best] != 0]
        best = best[np.unique(codes[best] >> CHECK_BITS, return_index=True)[1]]
        self.codes = codes[best]
        self.E = self.random.normal(0, 0.05, (len(best) + 1, DIM)).astype(np.float32)
        self.E[1:, 0] = np.clip(odds[best], -3, 3) * 0.25
        self.E[0] = 0
        self.index()

    def fit(self, texts: list[np.ndarray], label: np.ndarray) -> None:
        share = float(label.mean())
        self._vocabulary(texts, label)
        texts = [self.rows(t) for t in texts]
        squares = {k: np.full_like(v, 1e-2) for k, v in (("E", self.E), ("out", self.out))}
        squares |= {f"W{w}": np.full_like(self.W[w], 1e-2) for w in WIDTHS} | {f"b{w}": np.full_like(self.b[w], 1e-2) for w in WIDTHS}
        order = np.random.default_rng(11)
        epochs = int(np.clip(STEPS * BATCH / max(len(texts), 1), EPOCHS, 5 * EPOCHS))
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(texts)), max(1, len(texts) // BATCH)):
                self._step([texts[i] for i in part], label[part], share, squares)

    def _step(self, texts: list[np.ndarray], label: np.ndarray, share: float, squares: dict[str, np.ndarray]) -> None:
        pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.int64)
        ids = np.concatenate(texts)
        begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        x = self.E[ids].sum(axis=1)
        for k, w in enumerate(WIDTHS):
            n = len(ids) - w + 1
            if n <= 0:
                continue
            response = sum(x[i : i + n] @ self.W[w][i] for i in range(w)) + self.b[w]
            for r, t in enumerate(texts):
                if len(t) >= w:
                    block = response[begin[r] : begin[r + 1] - w + 1]
                    where[r, k * FILTERS : (k + 1) * FILTERS] = (best := block.argmax(axis=0)) + begin[r]
                    pooled[r, k * FILTERS : (k + 1) * FILTERS] = block[best, np.arange(FILTERS)]
        alive = pooled > 0
        pooled *= alive
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))
        error = ((p - label) * np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(texts)).astype(np.float32)
        back = error[:, None] * self.out * alive

        def move(name: str, value: np.ndarray, g: np.ndarray) -> None:
            squares[name] += g * g
            value -= RATE * g / np.sqrt(squares[name])

        move("out", self.out, error @ pooled)
        self.bias -= np.float32(RATE * error.sum())
        rows, grads = [], []
        for k, w in enumerate(WIDTHS):
            g, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
            use = np.flatnonzero(np.array([len(t) >= w for t in texts]))
            if not len(use):
                continue
            g, at = g[use], at[use]
            dw = np.zeros_like(self.W[w])
            for i in range(w):
                e = x[at + i]
                dw[i] = np.einsum("rf,rfd->df", g, e)
                rows.append(ids[at + i].reshape(-1, ids.shape[1]))
                grads.append((g[:, :, None] * self.W[w][i].T[None]).reshape(-1, DIM))
            move(f"W{w}", self.W[w], dw)
            move(f"b{w}", self.b[w], g.sum(axis=0))
        if rows:
            hit = np.concatenate(rows)
            touched, place = np.unique(hit.ravel(), return_inverse=True)
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, place, np.repeat(np.concatenate(grads), hit.shape[1], axis=0))
            g[touched == 0] = 0
            squares["E"][touched] += g * g
            self.E[touched] -= RATE * g / np.sqrt(squares["E"][touched])

    def score(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(codes, bounds) * self.scale + self.shift, -35, 35)))


def train(texts: list[np.ndarray], label: np.ndarray, aside: np.ndarray, lang: np.ndarray) -> bytes:
    """A packed network; rows kept aside set the shift and the thresholds of languages alone."""
    net = Network()
    if len(set(label.tolist())) < 2:
        net.out[:] = 0
        net.bias = np.float32(0 if not len(label) else np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6)))
        return net.pack()
    if len(set(label[~aside].tolist())) < 2 or len(set(label[aside].tolist())) < 2:
        aside = np.zeros(len(label), dtype=bool)
    rest = np.flatnonzero(~aside)
    net.fit([texts[i] for i in rest], label[rest])
    use = np.flatnonzero(aside) if aside.any() else rest
    ready = Network.unpack(net.pack())
    logit = np.array([ready.logits(texts[i], np.array([0, len(texts[i])]))[0] for i in use])
    label, lang = label[use], lang[use]
    logit = logit.astype(np.float64)
    common = float(best_cut(logit, label))
    net.shift = float(np.log(CUT / (1 - CUT)) - common)
    for name in sorted({x for x in lang.tolist() if x}):
        own = lang == name
        n = min(int(np.sum(label[own] == 1)), int(np.sum(label[own] == 0)))
        if n >= LEAST:
            # the fewer rows a language has, the nearer its cut stays to that of all
            cut = common + (float(best_cut(logit[own], label[own])) - common) * n / (n + POOLED)
            net.thresholds[name] = float(1 / (1 + np.exp(-np.clip(cut + net.shift, -35, 35))))
    return net.pack()


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, label_col: str = "toxic") -> bytes:
    rows = labelled(docs, labels, label_col, folds, fold, MAX_LABELLED)

    @freed
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label, aside, lang, left = [], [], [], [], MAX_BYTES
        for batch in batches:
            ys, places, names = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for row, end, buf, off in T.text_slices(lowered(batch.column(0))):
                left -= len(buf)
                if left < 0:
                    break
                codes, bounds = word_codes(buf, off)
                texts += [codes[bounds[i] : bounds[i + 1]] for i in range(end - row)]
                label += ys[row:end]
                aside += [p % 5 == 0 for p in places[row:end]]
                lang += names[row:end]
        packed = train(texts, np.array(label, np.int64), np.array(aside, dtype=bool), np.array(lang, dtype=object))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])

    one = rows.select("text", "label", "place", "lang").repartitionByRange(1, "place").sortWithinPartitions("place", "text")
    found = one.mapInArrow(fit, "model binary").collect()
    return bytes(found[0][0]) if found else train([], np.zeros(0, np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=object))


def score(docs: DataFrame, packed: bytes, folds: int = 3, fold: int = 1, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = _scored(rows, packed, ["doc_id"], "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _scored(rows: DataFrame, packed: bytes, keep: list[str], name: str) -> DataFrame:
    """The columns to keep, and the score under this name."""
    held = rows.sparkSession.sparkContext.broadcast(packed)
    at, kept = rows.columns.index("text"), [rows.columns.index(c) for c in keep]

    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpack(held.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, end, buf, off in T.text_slices(lowered(batch.column(at))):
                out[row:end] = net.score(*word_codes(buf, off))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out)], [*keep, name])

    return rows.mapInArrow(over, StructType([*(rows.schema[i] for i in kept), StructField(name, DoubleType())]))


def keep_clean(docs: DataFrame, packed: bytes) -> DataFrame:
    """The documents whose score is under the threshold of their language, with the columns that they came with."""
    limit = F.lit(CUT)
    if "lang" in docs.columns:
        for name, cut in Network.unpack(packed).thresholds.items():
            limit = F.when(F.col("lang") == name, F.lit(cut)).otherwise(limit)
    score = fresh(docs, "toxicity_score")
    return _scored(docs, packed, docs.columns, score).filter(F.col(score) < limit).drop(score)
