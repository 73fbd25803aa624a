"""Exact Jaccard self-join of documents on their word n-grams: size-banded tiles with hashed bitmap signatures.

Texts with equal sets are one class, told by a 128-bit sum over the set, and the class's smallest id stands for it. Sets
are dealt into size bands (each half as wide again as the one before; a set just above a band also enters it). Two sets
of a band that are similar enough differ in at most k elements, so the hash range is cut into more than k parts and
such sets agree on a whole part: a tile is a band, a part and that part's content, and every similar pair meets in one.

1. Tiles that hold two documents go on. In each every class is paired with the tile's smallest id. Pairs whose parity bitmaps differ in more bits than the
   sizes allow are out (the bits that differ bound the overlap from above); the rest are intersected as sorted arrays.
2. The links give components. Tiles whose other sets lie in several components are compared throughout, across components
   only, in square blocks of ``CHUNK`` sets by their bitmaps, and what passes is intersected too; of tiles that hold the
   same sets one is.
3. All links give the final components. Pairs inside one component need no test, so a group of near copies costs a
   star, not a square, and no link is lost.

Defined cases: null and empty texts have the empty set, are linked with nothing and are their own component; texts of
fewer than n words have one element, the whole sequence; ids are taken as unique, rows that share one are one node; a
null id gets a null component unless equal texts lend one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as T
from lodestone.llm.frames import cut, freed
from lodestone.llm.graph import components

GROWTH = 1.5
LEAST_BITS = 256
CHUNK = 1024
#: Bytes of text whose sets are made at once where sets stand alone.
SLICE = 1 << 19
#: Members that one task compares with the head of a tile.
STAR = 512
#: Pairs that a round takes for each set that pairs are made of.
MOVED = 2
#: Elements of sets for each bucket of tiles, and rows of a batch that a bucket gives.
BUCKET, ROWS = 4 << 20, 1 << 18


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each row."""
    starts, ends, bounds = T.word_spans(buf, off)
    words = T.word_hashes(T.LOWER[buf], starts, ends)
    grams, at = T.gram_hashes(words, bounds, n)
    cuts = np.searchsorted(at, bounds)
    out = []
    for i in range(len(off) - 1):
        held = bounds[i + 1] - bounds[i]
        if held >= n:
            out.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
        elif held:
            whole = words[bounds[i] : bounds[i + 1]]
            total = np.sum(whole * (np.arange(held, dtype=np.uint64) * np.uint64(2) + np.uint64(3)), keepdims=True)
            out.append(T.mix64(total ^ np.uint64(0xA5A5A5A5A5A5A500 + int(held))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def allowed(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The most elements in which two similar sets of these sizes together can differ."""
    return total * (100 - percent) // (100 + percent)


def bands(percent: int, top: int = 1 << 31) -> list[tuple[int, int, int, int]]:
    """(first size, end of own sizes, largest size that enters, parts) of each band; 0 parts where only equal sets are similar."""
    out, low = [], 1
    while low < top:
        high = max(low + 1, int(np.ceil(low * GROWTH)))
        most = (high - 1) * 100 // percent
        k = int(allowed(high - 1 + most, percent))
        out.append((low, high, most, 0 if k == 0 else k + 2 + k // 16))
        low = high
    return out


def tile_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Tiles of each set. A part that is empty makes a tile only for sets with so many of them that they could be all that two sets share."""
    size = np.array([len(s) for s in sets], np.int64)
    table = bands(percent, int(size.max(initial=0)) + 1)
    lows = np.array([b[0] for b in table] or [1])
    own = np.searchsorted(lows, size, side="right") - 1
    keys: list[list[np.ndarray]] = [[] for _ in sets]
    jobs = []
    for i, (n, b) in enumerate(zip(size.tolist(), own.tolist(), strict=True)):
        if n:
            jobs.append((i, b))
            if b and n <= table[b - 1][2]:
                jobs.append((i, b - 1))
    for i, b in jobs:
        parts = table[b][3]
        if not parts:
            continue
        h = sets[i]
        place = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        part = place[first]
        content = np.add.reduceat(T.mix64(h ^ np.uint64(0x3C6EF372FE94F82B)), first)
        spare = parts - 1 - int(allowed(table[b][1] - 1 + table[b][2], percent))
        if parts - len(part) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part)
            part, content = np.concatenate([part, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
        # 48 bits: keys that clash by chance cost a comparison, not a link
        keys[i].append(T.mix64(content + T.mix64(part + np.uint64((b + 1) << 32))) >> np.uint64(16))
    return [np.unique(np.concatenate(k)) if k else np.zeros(0, np.uint64) for k in keys]


def class_sums(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit sums over the elements of each set, which tell equal sets."""
    return tuple([int(np.sum(T.mix64(s ^ np.uint64(salt)), dtype=np.uint64)) for s in sets] for salt in (0x9216D5D98979FB1B, 0x2FFD72DBD01ADFB7))


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """Of each set two to four bits an element: bit i is the parity of the elements that end in i."""
    out = []
    for s in sets:
        bits = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length() if len(s) else 0)
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller size: the parities of the places that fall together."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 8 > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, off in T.text_slices(batch.column(1), SLICE):
                sets = shingle_sets(buf, off, n)
                one, two = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in class_sums(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array([len(s) for s in sets], pa.int64()), one, two, pa.array(bitmaps(sets), pa.binary())],
                    ["doc", "n", "f1", "f2", "bits"],
                )

    return docs.mapInArrow(over, "doc long, n long, f1 long, f2 long, bits binary")


def _sent(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, keys, docs): of each slice of rows the tiles that fall into a bucket, six bytes a key, and the document of each."""

    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of equal sets in a task one is sent
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, end, buf, off in T.text_slices(batch.column(1)):
                sets = shingle_sets(buf, off, n)
                for i, sums in enumerate(zip(*class_sums(sets), strict=True)):
                    if sums in seen:
                        sets[i] = sets[i][:0]
                    seen.add(sums)
                tiles = tile_keys(sets, percent)
                key = np.concatenate(tiles)
                doc = np.repeat(ids[row:end], [len(t) for t in tiles])
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, doc = key[order], doc[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                have = np.flatnonzero(np.diff(cuts))
                six = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :6])
                parts = [(cuts[b], cuts[b + 1]) for b in have.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(have.astype(np.int32)), pa.array([six[a:z].tobytes() for a, z in parts], pa.binary()), pa.array([pack.compress(np.diff(doc[a:z], prepend=0).tobytes()) for a, z in parts], pa.binary())],
                    ["bucket", "keys", "docs"],
                )

    return docs.mapInArrow(over, "bucket int, keys binary, docs binary")


def _met(sent: DataFrame, buckets: int) -> DataFrame:
    """(tile, doc) of the tiles that several documents are in."""

    def tiles(keys: list[bytes], docs: list[bytes]) -> Iterator[pa.RecordBatch]:
        total = sum(map(len, keys)) // 6
        wide = np.zeros((total, 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
        tile, doc = wide.view(np.int64).ravel(), np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(d), np.int64)) for d in docs])
        order = np.argsort(tile, kind="stable")
        tile, doc = tile[order], doc[order]
        head = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        keep = np.repeat(several, np.diff(np.append(head, total)))
        tile, doc = tile[keep], doc[keep]
        for at in range(0, len(tile), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(tile[at : at + ROWS]), pa.array(doc[at : at + ROWS])], ["tile", "doc"])

    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, docs = None, [], []
        for batch in batches:
            for b, k, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now and keys:
                    yield from tiles(keys, docs)
                    keys, docs = [], []
                now = b
                keys.append(k)
                docs.append(d)
        if keys:
            yield from tiles(keys, docs)

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(over, "tile long, doc long")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, na, bits_a, b, nb, bits_b) that sizes and bitmaps leave possible."""

    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy() for i in (1, 4))
            both = zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)
            differ = np.array([int(np.bitwise_count(folded(x, min(len(x), len(y))) ^ folded(y, min(len(x), len(y)))).sum()) for x, y in both], np.int64)
            keep = pa.array(differ <= allowed(na + nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(keep)

    return pairs.select("a", "na", "bits_a", "b", "nb", "bits_b").mapInArrow(over, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * (100 + percent) >= percent * (len(x) + len(y))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Heads meet their members in groups of about ``STAR``."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups")).withColumnRenamed("a", "h")
    dealt = pairs.join(many, F.col("a") == F.col("h")).select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), "b")
    heads = many.select(F.col("h").alias("a"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.col("h").alias("doc"), F.lit(0).alias("role"))
    calls = heads.union(dealt.select("a", "salt", F.col("b"), F.lit(1)))
    rows = texts.join(calls.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d")).select("a", "salt", "role", "d", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            a, salt, role, doc = (batch.column(i).to_pylist() for i in range(4))
            found: tuple[list[int], list[int]] = ([], [])
            for row, end, buf, off in T.text_slices(batch.column(4), SLICE):
                for i, s in enumerate(shingle_sets(buf, off, n), row):
                    if role[i] == 0:
                        key, head = (a[i], salt[i]), s
                    elif key == (a[i], salt[i]) and similar(head, s, percent):
                        found[0].append(a[i])
                        found[1].append(doc[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return rows.mapInArrow(over, "a long, b long")


def _rounds(pairs: DataFrame, rows: int, step: Callable[[DataFrame], DataFrame], name: str, by: str = "a") -> DataFrame:
    """What a step gives for pairs, or for rows of tiles, written. A round takes those whose column ``by`` has a part of all hashes, about ``MOVED`` times as many as the table has rows that the step joins them with, so what lies on disk at once does not follow their number."""
    pairs = cut(pairs, "pairs")
    rounds = max(1, math.ceil(pairs.count() / max(1, MOVED * rows)))
    out = None
    for k in range(rounds):
        part = pairs.filter(F.pmod(F.xxhash64(by, F.lit(4)), F.lit(rounds)) == k) if rounds > 1 else pairs
        found = cut(step(part), name)
        out = found if out is None else out.unionAll(found)
    return out


def _across(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a tile and pass the bitmap bound; rows are (tile, doc, component, n, bits)."""
    counts = tiles.groupBy(F.col("tile").alias("t")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = tiles.join(counts, F.col("tile") == F.col("t")).withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    blocks = dealt.select("tile", "doc", "component", "n", "bits", "chunk", other)
    blocks = blocks.select("tile", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "doc", "component", "n", "bits")

    def compare(rows: pa.Table, x: int, y: int) -> pa.RecordBatch:
        chunk, doc, comp, n = (rows.column(k).to_numpy() for k in ("chunk", "doc", "component", "n"))
        bits = rows.column("bits").to_pylist()
        # sizes in a tile differ by less than two, so little is lost at the smallest of their bitmaps
        least = min(map(len, bits))
        maps = np.stack([folded(x, least) for x in bits])
        left, right = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
        found = []
        for i in left.tolist():
            to = right[(doc[right] > doc[i]) if x == y else slice(None)]
            to = to[comp[to] != comp[i]]
            if len(to):
                differ = np.bitwise_count(maps[to] ^ maps[i]).sum(axis=1, dtype=np.int64)
                to = to[differ <= allowed(n[to] + n[i], percent)]
                found.append(np.stack([np.full(len(to), doc[i]), doc[to]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    @freed
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key and held:
                    yield compare(pa.Table.from_batches(held), key[1], key[2])
                    held = []
                key = keys[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield compare(pa.Table.from_batches(held), key[1], key[2])

    return blocks.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y").mapInArrow(over, "a long, b long").distinct()


def join(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    profile = cut(_profiles(rows, n), "profiles")
    member = profile.select("doc", "n", "f1", "f2")
    classes = cut(member.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep")), "classes")
    match = (F.col("n") == F.col("n_")) & (F.col("f1") == F.col("f1_")) & (F.col("f2") == F.col("f2_"))
    # buckets of a bounded size, whatever the size of the table
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // BUCKET + 1)
    met = _met(_sent(rows.filter("doc is not null"), n, percent, buckets), buckets)
    reps = member.filter("n > 0").join(classes.toDF("n_", "f1_", "f2_", "rep"), match).select(F.col("doc").alias("d"), "rep").distinct()
    met = cut(met.join(reps, F.col("doc") == F.col("d")).select("tile", F.col("rep").alias("doc")), "tiles")
    texts = cut(rows.join(met.select(F.col("doc").alias("d")).distinct(), F.col("doc") == F.col("d"), "left_semi"), "texts")
    facts = profile.select(F.col("doc").alias("d"), F.col("n"), "bits").join(met.select(F.col("doc").alias("m")).distinct(), F.col("d") == F.col("m"), "left_semi")
    facts = cut(facts, "facts")
    heads = met.groupBy(F.col("tile").alias("t")).agg(F.min("doc").alias("head"))
    rays = cut(met.join(heads, F.col("tile") == F.col("t")).filter("doc <> head").select("tile", "head", "doc"), "rays")
    star = rays.select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    held = facts.count()

    def bounded(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(facts.toDF("d", "na", "bits_a"), F.col("a") == F.col("d")).drop("d")
        return _bounded(rows.join(facts.toDF("d", "nb", "bits_b"), F.col("b") == F.col("d")).drop("d"), percent)

    def linked(pairs: DataFrame) -> DataFrame:
        return _rounds(pairs, held, lambda part: _verified(part, texts, n, percent), "links")

    links = linked(_rounds(star, held, bounded, "near"))
    first = components(links)
    label = F.coalesce("component", "doc").alias("component")
    placed = rays.join(first, F.col("doc") == F.col("node"), "left").select("tile", "doc", label)
    # pairs with the head are tested; of tiles that hold the same others one is compared, told by their number and two sums over them
    told = [F.sum(F.xxhash64("doc", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    mixed = placed.groupBy(F.col("tile").alias("t")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"), *told).filter("lo <> hi")
    mixed = mixed.groupBy("many", "s1", "s2").agg(F.min("t").alias("t")).select("t")
    open_tiles = placed.join(mixed, F.col("tile") == F.col("t"), "left_semi")

    def across(part: DataFrame) -> DataFrame:
        return _across(part.join(facts, F.col("doc") == F.col("d")).select("tile", "doc", "component", "n", "bits"), percent)

    more = linked(_rounds(open_tiles, held, across, "near", "tile").distinct())
    final = components(links.union(more))
    named = classes.join(final, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    named = named.toDF("n_", "f1_", "f2_", "component")
    return member.join(named, match, "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
