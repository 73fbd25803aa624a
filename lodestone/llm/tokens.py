"""Token ids in patched frame-of-reference files.

Texts are encoded with a public tokenizer (``tokenizers`` library), each document ends with an end id, and ids are
written in ascending document order. A tokenizer never joins signs over white space here (its pre-tokenizer drops
it), so a text is cut at white space and before a run of closing signs behind a letter, every distinct piece is encoded
once while it stays in a worker's cache, and the ids of the text are put together from those of its pieces.

File: blocks of ``BLOCK`` ids. A block holds its minimum, a width, the ids less the minimum bit plane by bit plane at
that width, and the ids that need more bits as exceptions (place, value). The width is the one of those that ``SHARES``
of the ids fit in that takes the least bytes. Behind the blocks stand the index of block starts, the document ids and
their lengths in ids, and a trailer. A reader takes any document from the blocks that it lies in.

Defined cases: a null or empty text is the end id alone; a null document id comes first; rows with the same id follow
each other by text; an empty table gives no file and no rows.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import text as T
from lodestone.llm.frames import cut, work_path

BLOCK = 8192
SHARES = (90, 95, 98, 100)
END_ID = 2
CACHE_ITEMS = 500_000
#: Ids of a file that a task reads back.
RANGE = 2 << 20
_MAGIC = b"LODEPFR1"
_HEAD = struct.Struct("<IIIB3x")
_TAIL = struct.Struct("<QQQQ8s")
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[33, 35, 36, 37, 38, 42, 44, 46, 58, 59, 63]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes each byte as: itself where it shows, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(free)) for b in range(256)}


def _fits(tokenizer: object) -> tuple[bool, bool]:
    """Whether plain letters pass the tokenizer's parts unchanged but for case, and whether its texts fall apart at white space.

    That is known of parts that compose signs, make white space one space and letters small, and take runs of letters,
    single digits and runs of other signs from between white space. Any other tokenizer gets its texts whole.
    """
    said = json.loads(tokenizer.to_str())
    parts = {k: [x["type"] for x in (said.get(k) or {}).get(k + "s" if k == "normalizer" else "pretokenizers", [])] for k in ("normalizer", "pre_tokenizer")}
    if parts != {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"]}:
        return False, False
    space, split = said["normalizer"]["normalizers"][1], said["pre_tokenizer"]["pretokenizers"]
    classes = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    known = space["pattern"] == {"Regex": r"\s+"} and space["content"] == " " and split[0]["pattern"].get("Regex", "").endswith(classes) and split[0]["invert"] and split[0]["behavior"] == "Removed"
    known = known and not split[1]["add_prefix_space"] and not split[1]["use_regex"] and said["model"]["type"] == "BPE" and not any(set(x["content"]) & set(" \t\n\r\v\f") or x["lstrip"] or x["rstrip"] for x in said["added_tokens"])
    return known, known


class Encoder:
    """Ids of whole texts; what it has learnt of pieces stays for the next batch."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.plain, self.cut_up = _fits(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        hard = []
        for p in pieces:
            # plain letters pass the normalizer and pre-tokenizer unchanged but for case
            if self.plain and p.isalpha() and max(p) < "ɐ" and "İ" not in p:
                p = p.lower()
                if not p.isascii():
                    p = "".join(map(self.letters.__getitem__, p.encode()))
                out.append([t.id for t in self.model.tokenize(p)])
            else:
                hard.append(len(out))
                out.append(None)
        if hard:
            for at, e in zip(hard, self.tokenizer.encode_batch_fast([pieces[i] for i in hard], add_special_tokens=False), strict=True):
                out[at] = e.ids
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row), each row closed by the end id."""
        if not self.cut_up:
            raw = buf.tobytes()
            texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            lists = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum())), size
        starts, ends, bounds = T.word_spans(buf, off)
        core = ends.copy()
        live = np.arange(len(starts))
        while len(live := live[(core[live] - starts[live] > 1) & _CLOSING[buf[core[live] - 1]]]):
            core[live] -= 1
        tail = (core < ends) & _LETTER[buf[core - 1]] if len(core) else np.zeros(0, dtype=bool)
        core[~tail] = ends[~tail]
        many = 1 + tail
        first = np.concatenate(([0], np.cumsum(many)))
        s, e = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        s[first[:-1]], e[first[:-1]] = starts, core
        s[first[1:][tail] - 1], e[first[1:][tail] - 1] = core[tail], ends[tail]
        hashes, at, item = np.unique(T.word_hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.place) + len(hashes) > CACHE_ITEMS:
            self._forget()
        keys = hashes.tolist()
        found = np.fromiter((self.place.get(k, -1) for k in keys), np.int64, len(keys))
        if len(fresh := np.flatnonzero(found < 0)):
            raw = buf.tobytes()
            new = self._encode([raw[s[i] : e[i]].decode("utf-8", "replace") for i in at[fresh].tolist()])
            size = np.fromiter(map(len, new), np.int64, len(new))
            begin = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1]))
            found[fresh] = len(self.starts) + np.arange(len(fresh))
            self.place.update(zip((keys[i] for i in fresh.tolist()), found[fresh].tolist(), strict=True))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in new for i in x), np.uint32, int(size.sum()))])
            self.starts, self.lengths = np.concatenate([self.starts, begin]), np.concatenate([self.lengths, size])
        place = found[item.reshape(-1)]
        begin, size = self.starts[place], self.lengths[place]
        stop = first[bounds[1:]]
        begin, size = np.insert(begin, stop, len(self.ids)), np.insert(size, stop, 1)
        total = np.concatenate(([0], np.cumsum(size)))
        store = np.append(self.ids, np.uint32(end_id))
        ids = store[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        closed = total[stop + 1 + np.arange(len(stop))]
        return ids, np.diff(closed, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_block(ids: np.ndarray) -> bytes:
    low = ids.min()
    rest = ids - low
    bits = np.ceil(np.log2(rest.astype(np.float64) + 1)).astype(np.int64)
    count = np.bincount(bits, minlength=33)
    over = len(ids) - np.cumsum(count)
    widths = {int(np.searchsorted(np.cumsum(count), len(ids) * share / 100)) for share in SHARES}
    width = min(widths, key=lambda w: (w * ((len(ids) + 7) // 8) + 6 * int(over[w]), w))
    patch = np.flatnonzero(bits > width)
    small = rest.astype(np.uint16) if width <= 16 else rest
    one = small.dtype.type(1)
    planes = b"".join(np.packbits((small >> small.dtype.type(b)) & one).tobytes() for b in range(width))
    return _HEAD.pack(len(ids), int(low), len(patch), width) + planes + patch.astype("<u2").tobytes() + rest[patch].astype("<u4").tobytes()


def unpack_block(data: memoryview) -> np.ndarray:
    n, low, patches, width = _HEAD.unpack_from(data)
    at, size = _HEAD.size, (n + 7) // 8
    kind = np.uint16 if width <= 16 else np.uint32
    out = np.zeros(n, kind)
    planes = np.unpackbits(np.frombuffer(data, np.uint8, width * size, at).reshape(width, size), axis=1, count=n)
    for b in range(width):
        out |= planes[b].astype(kind) << kind(b)
    at += width * size
    out = out.astype(np.uint32)
    out[np.frombuffer(data, "<u2", patches, at)] = np.frombuffer(data, "<u4", patches, at + 2 * patches)
    return out + np.uint32(low)


class Writer:
    """One file: blocks as ids come, then index, documents and trailer."""

    def __init__(self, out: io.BufferedIOBase | pa.NativeFile) -> None:
        self.out, self.at, self.left = out, 0, np.zeros(0, np.uint32)
        self.index: list[int] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self._put(_MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc: np.ndarray, null: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc.astype("<i8"))
        self.nulls.append(null.astype(np.uint8))
        self.lengths.append(length.astype("<u8"))
        ids = np.concatenate([self.left, ids])
        full = len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.left = ids[full:]

    def _block(self, ids: np.ndarray) -> None:
        self.index.append(self.at)
        self._put(pack_block(ids))

    def close(self) -> tuple[int, int]:
        if len(self.left):
            self._block(self.left)
        docs, lengths = np.concatenate(self.docs), np.concatenate(self.lengths)
        start = self.at
        self._put(np.array([*self.index, start], "<u8").tobytes())
        self._put(docs.tobytes() + lengths.tobytes() + np.concatenate(self.nulls).tobytes())
        self._put(_TAIL.pack(start, len(self.index), len(docs), int(lengths.sum()), _MAGIC))
        return len(docs), int(lengths.sum())


class Reader:
    """Documents of a file in any order, from an input with seek and read."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        size = file.size()
        file.seek(size - _TAIL.size)
        start, blocks, docs, self.total, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        file.seek(start)
        rest = file.read(size - _TAIL.size - start)
        self.index = np.frombuffer(rest, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.docs, self.lengths = np.frombuffer(rest, "<i8", docs, at), np.frombuffer(rest, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.nulls = np.frombuffer(rest, np.uint8, docs, at + 16 * docs).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids from place ``first`` up to ``end`` of the file."""
        if end <= first:
            return np.zeros(0, np.uint32)
        b0, b1 = first // BLOCK, (end - 1) // BLOCK + 1
        self.file.seek(int(self.index[b0]))
        data = memoryview(self.file.read(int(self.index[b1] - self.index[b0])))
        parts = [unpack_block(data[int(self.index[b] - self.index[b0]) : int(self.index[b + 1] - self.index[b0])]) for b in range(b0, b1)]
        return np.concatenate(parts)[first - b0 * BLOCK : end - b0 * BLOCK]

    def runs(self, first: int = 0, stop: int | None = None, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids) in runs of about ``most`` ids, of the documents that start at places from ``first`` up to ``stop``."""
        row, last = np.searchsorted(self.starts[:-1], [first, self.total if stop is None else stop]).tolist()
        while row < last:
            end = max(int(np.searchsorted(self.starts, self.starts[row] + most, side="right")) - 1, row + 1)
            end = min(end, last)
            yield row, end, self.ids(int(self.starts[row]), int(self.starts[end]))
            row = end


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, path, docs, ids) of the files, written already; parts follow each other in document order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc").asc_nulls_first()).sortWithinPartitions(F.col("doc").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        path, draft, writer = f"{top}/part-{task.partitionId():06d}.pfor", f"{top}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}", None
        coder = encoder(tokenizer)
        for batch in batches:
            doc, null = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, end, buf, off in T.text_slices(batch.column(1)):
                if writer is None:
                    store.create_dir(top, recursive=True)
                    writer = Writer(out := store.open_output_stream(draft, compression=None))
                ids, length = coder.encode(buf, off, end_id)
                writer.add(doc[row:end], null[row:end], length, ids)
        if writer is not None:
            n, ids = writer.close()
            out.close()
            store.move(draft, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "docs": [n], "ids": [ids]})

    return cut(ordered.mapInArrow(write, "part int, path string, docs long, ids long"), "manifest")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a task reads the documents that start in a range of ids."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    reader = Reader(file)
                    for row, end, ids in reader.runs(first, first + RANGE):
                        data = memoryview(ids.astype("<u4").tobytes())
                        at = (reader.starts[row : end + 1] - reader.starts[row]) * 4
                        crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[row:end], mask=reader.nulls[row:end]), pa.array(reader.starts[row:end] + base), pa.array(reader.lengths[row:end]), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    placed = files.select("path", before.alias("base"), "ids")
    placed = placed.select("path", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("ids") - 1, F.lit(0)), F.lit(RANGE).cast("long"))).alias("first"))
    # files are listed in a written table; a range is a task, however small the list is
    placed = placed.repartition(int(files.agg(F.sum(F.ceil(F.greatest("ids", F.lit(1)) / RANGE))).first()[0] or 1), "path", "first")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids below the shared folder and read them back."""
    folder = work_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer or default_tokenizer(), end_id), folder)
