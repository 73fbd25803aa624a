"""Exact dense retrieval and vector functions on arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestone.batches import give_back
from lodestone.operators.lexical import top_k
from lodestone.sources.corpus import listed

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalized(v: Column) -> Column:
    size = F.greatest(norm(v), F.lit(1e-9))
    return F.transform(v, lambda x: x / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_pooled(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the token vectors (keys, vector, mask) whose mask is 1, coordinate by coordinate."""
    rows = tokens.select(*keys, "mask", F.posexplode("vector").alias("i", "x"))
    sums = rows.groupBy(*keys, "i").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum(F.col("mask")).cast("double"), F.lit(1e-9))).alias("x"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, visible: DataFrame | None = None) -> DataFrame:
    """(query_id, int_id, score, rank) by inner product; queries are (query_id, vector). What is not visible is out before ranks."""
    if visible is not None and visible.columns == ["int_id"]:
        vectors = vectors.join(visible, "int_id", "left_semi")
    pairs = vectors.select("int_id", "embedding").crossJoin(listed(queries.select("query_id", "vector")))
    if visible is not None and visible.columns != ["int_id"]:
        pairs = pairs.join(visible, visible.columns, "left_semi")
    return top_k(pairs.select("query_id", "int_id", dot(F.col("embedding"), F.col("vector")).alias("score")), k)


def embedder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dim: int = DIM, batch: int = 32) -> Callable[[Column], Column]:
    """A column function of a text model that takes lists of up to ``batch`` texts. ``load`` runs once in a task; null texts count as empty.
    Only ``batch`` texts at a time are Python objects, and vectors stay numbers of an array.

    Vectors are brought to length one; a model that gives vectors of another length than ``dim`` raises.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in parts:
            out = np.empty((len(texts), dim))
            for at in range(0, len(texts), batch):
                held = ["" if t is None else t for t in texts.slice(at, batch).to_pylist()]
                v = np.asarray(model(held), np.float64).reshape(-1, dim)
                if len(v) != len(held):
                    raise ValueError(f"the model gave {len(v)} vectors of {dim} for {len(held)} texts")
                out[at : at + batch] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, out.reshape(-1))
            give_back()

    return run


def query_encoder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], size: int = 1000) -> Callable[[str], list[float]]:
    """Vectors of length one of single queries, on the driver; the last ``size`` queries asked are remembered, and each call gets a list of its own."""
    model = load()

    @lru_cache(size)
    def one(text: str) -> tuple[float, ...]:
        v = np.asarray(model([text]), np.float64).reshape(-1)
        return tuple((v / max(float(np.linalg.norm(v)), 1e-9)).tolist())

    return lambda text: list(one(text))


def _hashed_words() -> Callable[[list[str]], Sequence[Sequence[float]]]:
    import xxhash

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIM))
        for v, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % DIM] += 1.0 if h >> 63 else -1.0
        return out

    return model


#: A fixed stand-in for a text model: signed hashed counts of words; zeros for no words.
hash_embedding = embedder(_hashed_words)


def loaded(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """A stored table of vectors (int_id, embedding); an empty one if any has another length than ``dim``, as an index of another model is not searched."""
    other = vectors.filter(F.coalesce(F.size("embedding") != dim, F.lit(True)))
    return vectors if other.isEmpty() else vectors.limit(0)


def upserted(vectors: DataFrame, fresh: DataFrame, dim: int = DIM) -> DataFrame:
    """One vector an id, the fresh one where there are two; fresh vectors of another length are left out.

    Of several fresh vectors of an id the one of the highest ``seq`` holds, if there is such a column, else the greatest.
    """
    order = F.struct(*(["seq"] if "seq" in fresh.columns else []), "embedding")
    rest = [c for c in vectors.columns if c != "int_id"]
    good = fresh.filter(F.size("embedding") == dim).groupBy("int_id").agg(*(F.max_by(c, order).alias(c) for c in rest))
    return vectors.join(good.select("int_id"), "int_id", "left_anti").unionByName(good)
