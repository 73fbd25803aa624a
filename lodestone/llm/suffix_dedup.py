"""Exact substring dedup by suffix arrays: bytes covered by a 50-byte string that also starts in a document with a smaller id.

1. Every 50-byte window has a minimizer, the leftmost smallest hash of its ``GRAM``-byte pieces, so equal windows have
   equal minimizers. Tasks send each minimizer of a slice of documents once to a bucket; those that a second slice or a
   second document of the slice holds come back as the slice's shared ones.
2. Around a document's shared minimizers stand its candidate windows. A slice sends each distinct fragment of them once,
   with the smallest and largest id that hold it, to the bucket of its minimizer: equal windows meet there.
3. A bucket's fragments, cut by a byte that UTF-8 never holds, are one shard: its suffix array by induced sorting and
   the permuted common prefixes give the runs of suffixes that share 50 bytes, and so each window's smallest id. Equal
   fragments stand there once, and one that is alone with its minimizer, which can share no window, is left out.
4. Slices turn that into spans of their documents, spans of a document are merged, and what remains is hashed.

A text that equals that of a smaller id is covered whole and takes no part in 1 to 3. No key gathers more than a row of
each slice in a task, and there is a shard for every ``SHARD`` bytes of text at least, so shards do not grow with the table.
A row is known by its id and a hash of its text; within a slice and within a shard equal pieces are told by 64-bit hashes.

Defined cases: null texts are empty; texts under 50 bytes keep all; null ids neither remove nor lose bytes; rows that
share an id are texts of their own, which do not remove each other's bytes; an empty table gives no rows; very long texts
are read in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as T
from lodestone.llm.frames import cut
from lodestone.llm.sais import permuted_prefixes, suffix_array

WIDTH = 50
GRAM = 24
SLICE = 1 << 20
#: Buckets for each shuffle partition, so that a shard is a few hundred kilobytes.
SHARDS = 4
#: Bytes of all texts for each bucket, where the shuffle partitions would make buckets larger.
SHARD = 8 << 20
_SPAN = WIDTH - GRAM + 1
#: Windows whose minimizers are found at once, so that they stay in a core's cache; a place among them has the bits of _PLACE.
PART = 1 << 15
_PLACE = np.uint64(0xFFFF)
_ROW = "bucket int, slice long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["bucket", "slice", "kind", "a", "b", "c", "d", "e", "f"]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *(None,) * (len(_NAMES) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full, strict=True), _KINDS, strict=True)] if full else [pa.array([], k) for k in _KINDS], _NAMES)


def _windows(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each 50-byte window of buf the place of its minimizer, and the hash of every piece of GRAM bytes."""
    words = T.mix64(np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,)))
    n = len(buf) - GRAM + 1
    value = np.zeros(n, np.uint64)
    for i in range(0, GRAM, 8):
        value += words[i : i + n] * T._GRAM[i]
    # the place goes in the lowest bits, so that the leftmost of equal hashes is the smallest
    best = (value & ~_PLACE) | np.arange(n, dtype=np.uint64)
    wide = 1
    while wide * 2 <= _SPAN:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if wide < _SPAN:
        best = np.minimum(best[: wide - _SPAN], best[_SPAN - wide :])
    return (best & _PLACE).astype(np.int64), value


def minimizer_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, place of the minimizer, hash) of the runs of windows that share a minimizer place; windows lie within rows."""
    buf = np.ascontiguousarray(buf)
    size = np.diff(off)
    whole = np.maximum(size - WIDTH + 1, 0)
    # whether a window begins here: so many places of a row do, the rest do not
    fits = np.repeat(np.tile([True, False], len(size)), np.stack([whole, size - whole], axis=1).ravel())
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(buf) - WIDTH + 1, PART):
        place, value = _windows(buf[at : at + PART + WIDTH - 1])
        n = len(place)
        here = fits[at : at + n]
        new = np.ones(n + 1, dtype=bool)
        new[1:-1] = (place[1:] != place[:-1]) | ~here[:-1] | ~here[1:]
        head, last = np.flatnonzero(new[:-1] & here), np.flatnonzero(new[1:] & here)
        out.append((at + head, at + last, at + place[head], value[place[head]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    first, last, place, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(off, first, side="right") - 1, first, last, place, h


def _slice_id(count: int) -> int:
    return (TaskContext.get().partitionId() << 32) | count


def _u(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(data or b"", kind)


def _listed(column: pa.Array) -> list:
    """The values of a column; numbers, and those of lists, by way of one array."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    if not pa.types.is_list(column.type) or column.values.null_count:
        return column.to_pylist()
    at = column.offsets.to_numpy()
    values = column.values.slice(at[0], at[-1] - at[0]).to_numpy().tolist()
    at = (at - at[0]).tolist()
    return [values[a:z] if ok else None for a, z, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[list]]]:
    """Rows, as lists, of each run of one key."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(_listed(c) for c in batch.columns), strict=True):
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _minimizers(docs: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: a slice's ids and prints. Kind 1: its minimizers of two documents (hash, document). Kind 2: by bucket, each hash once (document -1 if of kind 1)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, end, buf, off in T.text_slices(batch.column(2), SLICE):
                who, _, _, _, h = minimizer_runs(buf, off)
                if not len(h):
                    continue
                key, count = _slice_id(count), count + 1
                order = np.argsort(h, kind="stable")  # rows lie in order
                h, who = h[order], who[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
                h, who = h[new], who[new]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                many = np.diff(np.append(first, len(h)))
                both = np.repeat(many > 1, many)
                # rows that only hand a slice's own facts on are dealt by the slice
                rows = [(key % buckets, key, 0, ids[row:end].astype("<i8").tobytes(), prints[row:end].astype("<i8").tobytes()), (key % buckets, key, 1, h[both].astype("<u8").tobytes(), who[both].astype("<i4").tobytes())]
                one, whose = h[first], np.where(many > 1, -1, who[first]).astype("<i4")
                bucket = (one % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((whose, bucket))
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                short = (one >> np.uint64(16)).astype("<u8")
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    part = by[cuts[b] : cuts[b + 1]]
                    six = short[part].view(np.uint8).reshape(-1, 8)[:, :6]
                    rows.append((b, key, 2, np.ascontiguousarray(six).tobytes(), zstandard.compress(np.diff(whose[part], prepend=0).astype("<i4").tobytes(), 1)))
                yield _batch(rows)

    return docs.select("doc", "print", "text").mapInArrow(over, _ROW)


def _shared(entries: DataFrame, parts: int) -> DataFrame:
    """Kinds 0 and 1 as they are, and as kind 3 the hashes (their upper 48 bits) that another slice holds too."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            pass_on = [r for r in rows if r[2] != 2]
            rest = [r for r in rows if r[2] == 2]
            if rest:
                parts = []
                for r in rest:
                    wide = np.zeros((len(r[3]) // 6, 8), np.uint8)
                    wide[:, :6] = _u(r[3], np.uint8).reshape(-1, 6)
                    parts.append(wide.view("<u8").ravel())
                h = np.concatenate(parts)
                of = np.repeat(np.arange(len(rest)), [len(p) for p in parts])
                whose = np.concatenate([np.cumsum(_u(zstandard.decompress(r[4]), "<i4"), dtype=np.int64) for r in rest])
                s = np.sort(h)
                twice = np.unique(s[1:][s[1:] == s[:-1]])
                found = np.searchsorted(twice, h)
                keep = (whose >= 0) & (found < len(twice))
                keep[keep] = twice[found[keep]] == h[keep]
                cuts = np.searchsorted(of, np.arange(len(rest) + 1))
                for i, r in enumerate(rest):
                    k = slice(cuts[i], cuts[i + 1])
                    if (use := keep[k]).any():
                        pass_on.append((r[0], r[1], 3, h[k][use].tobytes(), whose[k][use].astype("<i4").tobytes()))
            yield _batch([r[:5] for r in pass_on])

    return entries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(over, _ROW)


def _wanted(replies: DataFrame) -> DataFrame:
    """(doc, print, keys): the upper 48 bits of the shared minimizers of each document that has any, ascending."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            ids, prints = (np.concatenate([_u(r[i], "<i8") for r in rows if r[2] == 0] or [np.zeros(0, np.int64)]) for i in (3, 4))
            h = np.concatenate([_u(r[3], "<u8") >> np.uint64(16 if r[2] == 1 else 0) for r in rows if r[2] > 0])
            who = np.concatenate([_u(r[4], "<i4") for r in rows if r[2] > 0])
            order = np.lexsort((h, who))
            h, who = h[order], who[order]
            cuts = np.searchsorted(who, np.arange(len(ids) + 1))
            have = np.flatnonzero(np.diff(cuts)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids[have], pa.int64()), pa.array(prints[have], pa.int64()), pa.array([h[cuts[i] : cuts[i + 1]].tobytes() for i in have], pa.binary())], ["doc", "print", "keys"])

    return replies.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(over, "doc long, print long, keys binary")


def _fragments(rows: DataFrame, buckets: int) -> DataFrame:
    """Of (doc, print, keys, text). Kind 0: a slice's ids and prints. Kind 1: occurrences (fragment, document, start). Kind 2: by bucket, fragments (number, smallest id, largest id, length, minimizer's place, bytes)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            ids, prints, keys = *(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), batch.column(2).to_pylist()
            for row, end, buf, off in T.text_slices(batch.column(3), SLICE):
                who, first, last, place, h = minimizer_runs(buf, off)
                held = [_u(k, "<u8") for k in keys[row:end]]
                # rows that hold 50 bytes are few enough for the 16 bits above a hash; a row's shared hashes lie ascending, and so do all
                want = np.concatenate(held) | (np.repeat(np.arange(len(held)), [len(k) for k in held]).astype(np.uint64) << np.uint64(48))
                have = (h >> np.uint64(16)) | (who.astype(np.uint64) << np.uint64(48))
                near = np.minimum(np.searchsorted(want, have), len(want) - 1)
                use = np.flatnonzero(want[near] == have)
                if not len(use):
                    continue
                who, first, size, pivot, h = who[use], first[use], last[use] + WIDTH - first[use], (place - first)[use], h[use]
                key, count = _slice_id(count), count + 1
                # fragments lie in ascending order of both ends
                print_ = T.mix64(T.span_hashes(buf, first, [first + size])[0] ^ h)
                _, sample, number = np.unique(print_, return_index=True, return_inverse=True)
                doc = ids[row:end][who]
                low, high = np.full(len(sample), np.iinfo(np.int64).max), np.full(len(sample), np.iinfo(np.int64).min)
                np.minimum.at(low, number, doc)
                np.maximum.at(high, number, doc)
                yield _batch([(key % buckets, key, 0, ids[row:end].astype("<i8").tobytes(), prints[row:end].astype("<i8").tobytes()), (key % buckets, key, 1, *(zstandard.compress(x.tobytes(), 3) for x in (number.astype("<i4"), who.astype("<i4"), (first - off[who]).astype("<i8"))))])
                bucket = (h[sample] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                out, pack = [], zstandard.ZstdCompressor(level=3)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    part = by[cuts[b] : cuts[b + 1]]
                    s, n = first[sample[part]], size[sample[part]]
                    stop = np.cumsum(n)
                    data = buf[np.repeat(s - (stop - n), n) + np.arange(stop[-1])]
                    out.append((b, key, 2, part.astype("<i4").tobytes(), low[part].astype("<i8").tobytes(), high[part].astype("<i8").tobytes(), n.astype("u1").tobytes(), pivot[sample[part]].astype("u1").tobytes(), pack.compress(data.tobytes())))
                yield _batch(out)

    # a task that runs again has to cut the same slices
    return rows.select("doc", "print", "keys", "text").sortWithinPartitions("doc", "print").mapInArrow(over, _ROW)


def smallest_ids(data: np.ndarray, size: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each byte place of distinct fragments (bytes one after the other, their sizes and smallest ids) the smallest id of the 50-byte string that starts there; the largest long where none fits."""
    none = np.iinfo(np.int64).max
    stop = np.cumsum(size + 1)
    frag = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(data)) + frag
    t = np.full(len(data) + len(size), 255, np.uint8)
    t[inner] = data
    frag = np.repeat(np.arange(len(size)), size + 1)
    fits = np.arange(len(t)) + WIDTH <= (stop - 1)[frag]
    sa = suffix_array(t)
    shared = permuted_prefixes(t, sa)[sa]
    shared[0] = 0
    group = np.cumsum(shared < WIDTH) - 1
    whole = fits[sa]
    place, group = sa[whole], group[whole]
    best = np.full(len(t), none)
    if len(place):
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        value = np.minimum.reduceat(low[frag[place]], head)
        best[place] = np.repeat(value, np.diff(np.append(head, len(place))))
    return best[inner]


def lost_runs(data: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's fragments (bytes one after the other, sizes, smallest and largest ids, places of minimizers) the runs of windows (fragment, first, last, smallest id) that the largest id loses."""
    begin = np.cumsum(size) - size
    # equal fragments stand in the shard once
    _, sample, number = np.unique(T.span_hashes(data, begin, [begin + size])[0], return_index=True, return_inverse=True)
    least = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(least, number, low)
    # equal windows have equal minimizers: a fragment that has its minimizer alone shares no window with another, and stays out of the suffix array
    piece = T.span_hashes(data, begin + pivot, [begin + pivot + GRAM])[0][sample]
    order = np.argsort(piece)
    new = np.concatenate(([True], piece[order][1:] != piece[order][:-1], [True]))
    alone = np.empty(len(sample), dtype=bool)
    alone[order] = new[:-1] & new[1:]
    one, some = np.flatnonzero(alone), np.flatnonzero(~alone)
    runs = [(one, np.zeros(len(one), np.int64), size[sample[one]] - WIDTH, least[one])]
    if len(some):
        n, start = size[sample[some]], begin[sample[some]]
        at = np.cumsum(n) - n
        best = smallest_ids(data[np.repeat(start - at, n) + np.arange(int(n.sum()))], n, least[some])
        frag = np.repeat(np.arange(len(n)), n)
        w = np.flatnonzero(best != np.iinfo(np.int64).max)
        head = np.concatenate(([True], (frag[w][1:] != frag[w][:-1]) | (best[w][1:] != best[w][:-1])))
        last = np.append(head[1:], True)
        f = frag[w[head]]
        runs.append((some[f], w[head] - at[f], w[last] - at[f], best[w[head]]))
    g, a, z, m = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(g, kind="stable")
    g, a, z, m = g[order], a[order], z[order], m[order]
    # the runs of a fragment are those of its equals
    lo = np.searchsorted(g, number)
    many = np.searchsorted(g, number, side="right") - lo
    f = np.repeat(np.arange(len(number)), many)
    run = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    lost = m[run] < high[f]
    f, run = f[lost], run[lost]
    return f, a[run], z[run], m[run]


def _resolved(fragments: DataFrame, parts: int) -> DataFrame:
    """Kinds 0 and 1 as they are, and as kind 3 the runs of windows (fragment, first, last, smallest id) that some document of the slice loses."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            out = [r[:6] for r in rows if r[2] != 2]
            rest = [r for r in rows if r[2] == 2]
            if rest:
                size, low, high, pivot = (np.concatenate([_u(r[i], k) for r in rest]).astype(np.int64) for i, k in ((6, "u1"), (4, "<i8"), (5, "<i8"), (7, "u1")))
                f, a, z, least = lost_runs(np.concatenate([_u(zstandard.decompress(r[8]), np.uint8) for r in rest]), size, low, high, pivot)
                of = np.repeat(np.arange(len(rest)), [len(r[3]) // 4 for r in rest])
                number = np.concatenate([_u(r[3], "<i4") for r in rest])
                cuts = np.searchsorted(of[f], np.arange(len(rest) + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    k = slice(cuts[i], cuts[i + 1])
                    out.append((rest[i][0], rest[i][1], 3, number[f[k]].astype("<i4").tobytes(), a[k].astype("u1").tobytes(), z[k].astype("u1").tobytes(), least[k].astype("<i8").tobytes()))
            yield _batch(out)

    return fragments.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(over, _ROW)


def _spans(resolved: DataFrame) -> DataFrame:
    """(doc, print, spans): merged pairs of begin and end of what each document loses."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            ids, prints = next((_u(r[3], "<i8"), _u(r[4], "<i8")) for r in rows if r[2] == 0)
            number, who, start = next(tuple(_u(zstandard.decompress(r[i]), k) for i, k in ((3, "<i4"), (4, "<i4"), (5, "<i8"))) for r in rows if r[2] == 1)
            runs = [r for r in rows if r[2] == 3]
            if not runs:
                continue
            f, a, z, least = (np.concatenate([_u(r[i], k) for r in runs]).astype(np.int64) for i, k in ((3, "<i4"), (4, "u1"), (5, "u1"), (6, "<i8")))
            order = np.argsort(f, kind="stable")
            f, a, z, least = f[order], a[order], z[order], least[order]
            lo, hi = np.searchsorted(f, number), np.searchsorted(f, number, side="right")
            many = hi - lo
            of = np.repeat(np.arange(len(number)), many)
            run = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            w = who[of]
            lose = least[run] < ids[w]
            w, begin, end = w[lose], (start[of] + a[run])[lose], (start[of] + z[run] + WIDTH)[lose]
            order = np.lexsort((begin, w))
            w, begin, end = w[order], begin[order], end[order]
            if not len(w):
                continue
            # ends counted from a base of each document, so that one running maximum serves all
            base = w.astype(np.int64) * (int(end.max()) + 1)
            far = np.maximum.accumulate(end + base)
            head = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (begin[1:] + base[1:] > far[:-1]))))
            last = np.append(head[1:], len(w)) - 1
            pairs = np.stack([begin[head], far[last] - base[last]], axis=1).astype("<i8")
            cuts = np.searchsorted(w[head], np.arange(len(ids) + 1))
            have = np.flatnonzero(np.diff(cuts)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids[have], pa.int64()), pa.array(prints[have], pa.int64()), pa.array([pairs[cuts[i] : cuts[i + 1]].tobytes() for i in have], pa.binary())], ["doc", "print", "spans"])

    return resolved.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(over, "doc long, print long, spans binary")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, print, spans) of rows that lose bytes, and (doc, print) of those whose text a smaller id has whole; both written."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col).filter("doc is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(SHARDS * parts, total // SHARD + 1)
    parts = max(parts, buckets // SHARDS)
    marks = rows.filter(F.octet_length("text") >= WIDTH).select("doc", "print", F.sha2("text", 256).alias("digest"))
    owners = marks.groupBy(F.col("digest").alias("g")).agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner <> last").select("g", "owner")
    # written, so that Spark can split a join whose rows are mostly copies of one text
    copies = cut(marks.join(cut(owners, "owners"), F.col("digest") == F.col("g")).filter("doc > owner").select("doc", "print"), "copies").distinct()
    keys = cut(_wanted(_shared(_minimizers(rows, max(1, buckets // SHARDS)), parts)), "keys")
    alone = keys.join(copies.toDF("c", "p"), (F.col("doc") == F.col("c")) & (F.col("print") == F.col("p")), "left_anti")
    with_text = alone.join(rows.toDF("d", "q", "text"), (F.col("doc") == F.col("d")) & (F.col("print") == F.col("q"))).select("doc", "print", "keys", "text")
    spans = cut(_spans(_resolved(_fragments(with_text, buckets), parts)), "spans")
    return spans, copies


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"))


def _apply(text: bytes, spans: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, and with keep_text what remains (cut bytes decoded with replacement)."""
    spans, copies = removed_spans(docs, id_col, text_col)
    lost = spans.select(F.col("doc").alias("d"), F.col("print").alias("p"), "spans", F.lit(False).alias("all")).unionAll(copies.select("doc", "print", F.lit(None).cast("binary"), F.lit(True)))
    lost = lost.groupBy("d", "p").agg(F.max("all").alias("all"), F.first("spans", ignorenulls=True).alias("spans"))
    rows = _rows(docs, id_col, text_col).join(lost, (F.col("doc") == F.col("d")) & (F.col("print") == F.col("p")), "left").select(F.col("doc").alias("doc_id"), "text", "all", "spans")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                data = memoryview(text.as_buffer())
                pairs = np.array([[0, len(data)]] if whole[i] else []).reshape(-1, 2) if whole[i] or not spans[i] else _u(spans[i], "<i8").reshape(-1, 2)
                kept = _apply(bytes(data), pairs) if len(pairs) else data
                values = (len(data), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), hashlib.sha256(kept).hexdigest(), bytes(kept).decode("utf-8", "replace") if keep_text else None)
                for to, v in zip(out, values, strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = rows.mapInArrow(over, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return found if keep_text else found.drop("kept")
