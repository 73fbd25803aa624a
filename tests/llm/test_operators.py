"""Each operator against a plain version, on rows with nulls, empty and long texts, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import string
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chaining, decontaminate, kdtree, mixing, ngram_join, quality, sais, suffix_dedup, tokens, toxicity, warc
from lodestone.llm import text as T
from lodestone.llm.frames import work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, n long, k string, size string, copy_id string, d string"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(70)
    out = [(0, None), (1, ""), (2, "one"), (3, "two words"), (4, "two words"), (5, " \t\n "), (6, text(4000))]
    base = text(120)
    for i in range(7, n):
        kind = i % 6
        if kind == 0:
            t = base if i % 12 else base.upper()
        elif kind == 1:
            w = base.split()
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = text(40) + " " + passage + " " + text(30)
        else:
            t = text(r.randint(1, 90))
        out.append((i, t))
    out += [(n, "a repeated row"), (n, "a repeated row")]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "é", None]), None, "x", 1, "x", "x", "x", "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_do_not_depend_on_place():
    for limit in (1, 7, 1 << 20):
        texts = ["a bb ccc", "", "ccc a", None, "x" * 50 + " bb"]
        got = defaultdict(set)
        for row, end, buf, off in T.text_slices(pa.array(texts), limit):
            s, e, b = T.word_spans(buf, off)
            for i in range(end - row):
                for j in range(b[i], b[i + 1]):
                    got[bytes(buf[s[j] : e[j]])].add(int(T.word_hashes(buf, s, e)[j]))
        assert all(len(v) == 1 for v in got.values()) and len({*map(frozenset, got.values())}) == len(got) == 4


def test_grams_stay_inside_rows():
    buf, off = np.frombuffer(b"a b c d e f", np.uint8), np.array([0, 5, 5, 11])
    s, e, b = T.word_spans(buf, off)
    assert [len(T.gram_hashes(T.word_hashes(buf, s, e), b, n)[0]) for n in (1, 2, 3, 4)] == [6, 4, 2, 0]


def test_mix(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = {r.doc_id: r.size for r in rows}
    assert all(size[i] == len(words(t)) for i, t, *_ in corpus())
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    order = sorted((s for s in targets if s is not None)) + [None]
    free = [targets[s][0] / (1 + i % 3) for i, s in enumerate(order) if targets[s][0] < 3 * targets[s][1] - 1e-6]
    assert free == pytest.approx([free[0]] * len(free))
    for s, (target, _) in targets.items():
        taken = sum(r.taken for r in rows if r.source == s)
        # whole documents: no nearer than half the longest one of the source
        assert abs(taken - target) <= max(0.1 * target, max(r["size"] for r in rows if r.source == s) / 2)
    assert all(r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix(none).count() == 0


def test_mix_reshares_what_a_source_cannot_use(spark):
    rows = [(i, "w " * 10, "a", None) for i in range(2)] + [(i + 10, "w " * 10, "b", None) for i in range(100)] + [(i + 200, "w " * 10, "c", None) for i in range(2)]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, x string")).collect()}
    assert got["a"].target == 60 and got["c"].target == 60 and got["b"].target == pytest.approx(1040 - 120)


def test_mix_takes_short_documents_more_often_and_fills_the_target(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.choice([5, 40, 400]), "a") for i in range(3000)] + [(i + 5000, "w " * 50, "b") for i in range(3000)]
    got = [x for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if x.source == "a"]
    share = {n: sum(x.copies for x in got if x["size"] == n) / sum(x["size"] == n for x in got) for n in (5, 40, 400)}
    assert share[5] > share[40] > share[400] > 0 and abs(sum(x.taken for x in got) - got[0].target) <= 5


def test_decontaminate(spark, none):
    bench = [(1, "The train leaves Paris at 10 km past noon and then it meets Bob at 25 km from there again"), (2, None), (3, ""), (4, "short one"), (5, "7 8 9 10 11 12 13 14 15")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    around = "something before all of that stands here, "
    rows = [
        (1, around + bench[0][1] + " and after."), (2, around + bench[0][1].upper().lower() + " ok"),
        (3, around + "the train leaves Rome at 44 km past noon and then it meets Eve at 31 km from there again"),
        (4, around + "the train leaves Rome at 44 km past the rest of this text, in which nothing follows at all"),
        (5, "7 8 9 10 11 12 13 14 15"), (6, None), (7, ""), (8, "short one"), (None, bench[0][1]),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(d, b).collect()}
    assert got[(1, 1)] == "verbatim" and got[(3, 1)] == "reparameterised" and (4, 1) not in got and (8, 4) in got
    assert {k[0] for k in got} == {1, 2, 3, 8}
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {4, 5, 6, 7, None}
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_decontaminate_slots_must_be_consistent(spark):
    b = spark.createDataFrame([(1, "first we add 5 apples to the big basket and later we add 5 pears to the small one")], "item_id long, text string")
    d = spark.createDataFrame([(1, "first we add 7 apples to the big basket and later we add 7 pears to the small one"), (2, "first we add 7 apples to the big basket and later we add 9 pears to the small one")], "doc_id long, text string")
    assert [(r.doc_id, r.kind) for r in decontaminate.leaks(d, b).collect()] == [(1, "reparameterised")]


def test_decontaminate_names_that_begin_sentences(spark):
    item = "Tom has 3 apples. Tom buys 4 more. Tom eats 2. How many does Tom have?"
    copy = "Anna has 5 apples. Anna buys 9 more. Anna eats 6. How many does Anna have?"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Here is one. {copy} End."), (2, item.lower()), (3, copy.replace("Anna buys", "Eve buys")), (4, "Tom has apples. How many does Tom have?")]
    got = {r.doc_id: r.kind for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert got == {1: "reparameterised", 2: "verbatim"}


def test_decontaminate_items_of_few_words(spark):
    b = spark.createDataFrame([(1, "Compute 12 + 7 = 19"), (2, "7 8 9 10 11 12 13 14 15"), (3, "1.5 km 2:30 h 4 kg 7")], "item_id long, text string")
    rows = [(1, "now compute 12 + 7 = 19 at once"), (2, "so 7 8 9 10 11 12 13 14 15 and on"), (3, "is 1.5 km 2:30 h 4 kg 7 or so"), (4, "now compute 12 + 8 = 20 at once"), (5, "17 18 19 20 21 22 23 24 25"), (6, "is 1.5 km 2:31 h 4 kg 7 or so")]
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert got == {(1, 1, "verbatim"), (2, 2, "verbatim"), (3, 3, "verbatim")}


def test_warc_round_trip(spark):
    long = "é" * 300_000
    pages = [(5, "http://a/1", "x" * 150), (3, "http://a/\r\n2", "x" * 150), (9, None, "x" * 150), (1, "http://b", "short"), (2, "http://b", "short"), (4, "http://c", None), (6, "http://c", ""), (7, "http://d", long), (None, "http://e", "y" * 200), (8, "u", "WARC/1.0 \x1f\u008b\x08" * 40)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.archive_pages(df).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        first = min((p for p, _, h in pages if h == html and p is not None), default=None)
        again = len(data) >= 100 and i is not None and i != first
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_ranges_own_each_record_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", random.Random(i).randbytes(300).hex()) for i in range(40)], "page_id long, url string, html string")
    folder = work_path(spark, "warc-test")
    files = warc.write_archives(df, folder)
    for step in (100, 333, 5000, 1 << 20):
        read = warc.read_archives(files, folder, step)
        assert read.rdd.getNumPartitions() == sum(-(-r.bytes // step) for r in files.collect())
        rows = read.collect()
        assert sorted(r.record_id for r in rows) == sorted(f"<urn:page:{i}>" for i in range(40))
        assert {hashlib.sha256(bytes(r.payload)).hexdigest() for r in rows} == {r.payload_digest for r in rows}


def test_warc_skips_damage_and_false_magic():
    good = [warc._record(i, "u", b"payload %d" % i, "d", None) for i in range(3)]
    packed = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in good]
    parts = [p.compress(g) + p.flush() for p, g in zip(packed, good, strict=True)]
    data = b"\x1f\x8b\x08 junk" + parts[0] + b"\x1f\x8b\x08\x00" + parts[1][:20] + parts[2]
    with pa.BufferReader(data) as f:
        found = [fields["warc-record-id"] for _, fields, _ in warc.records_in(f, 0, len(data))]
    assert found == ["<urn:page:0>", "<urn:page:2>"]


def labelled_corpus(spark, mark: str):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        t = [r.choice(vocab) for _ in range(40)]
        y = i % 3 == 0
        if y:
            t[r.randrange(40)] = mark
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(y), int(y)))
    rows += [(1000, None, None, None), (1001, "", "zz", None), (1002, "x " * 20_000, "en", "s"), (None, "a", "b", "c")]
    labels += [(5, None, None), (None, 1, 1), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,column,folds,fold", [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_classifiers(spark, module, column, folds, fold):
    docs, labels = labelled_corpus(spark, "Vileword")
    model = module.learn(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r[column] for r in labels.filter(f"doc_id is not null and {column} is not null").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    empty = {r.doc_id: r.score for r in rows}
    assert empty[1000] == empty[1001]
    assert module.score(docs.limit(0), model).count() == 0
    nothing = module.score(docs, module.learn(docs, labels.limit(0))).select("score").distinct().collect()
    assert len(nothing) == 1 and nothing[0].score == pytest.approx(0.5, abs=0.01)


def test_toxicity_keeps_columns_and_clean_rows(spark):
    docs, labels = labelled_corpus(spark, "Vileword")
    more = docs.withColumn("toxicity_score", F.lit(1))
    kept = toxicity.keep_clean(more, toxicity.learn(docs, labels))
    assert kept.columns == more.columns
    left = {r.doc_id for r in kept.collect()}
    bad = {r.doc_id for r in docs.filter("text like '%Vileword%'").collect()}
    assert len(left & bad) <= 0.1 * len(bad) and len(left) >= 0.9 * (404 - len(bad))


def test_tree_search_is_exact():
    r = np.random.default_rng(2)
    for big in (5, 60, 10**8):
        points, ids, queries = r.integers(-big, big, (700, 6)), r.permutation(700) - 350, r.integers(-big, big, (9, 6))
        got, score = kdtree.Tree(ids, points).search(queries, np.full(9, -np.inf), 21)
        for q in range(9):
            want = sorted((-int(points[j] @ queries[q]), int(ids[j])) for j in range(700))[:21]
            assert [(-int(s), int(i)) for s, i in zip(score[q], got[q], strict=True)] == want


def test_top_k(spark, monkeypatch):
    r = random.Random(1)
    same = [0.25] * 4
    rows = [(i, same if i % 3 == 0 else [r.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0]), (340, [float("nan"), 0.0, 0.0, 0.0]), (360, [float("inf"), 0.0, 0.0, 0.0]), (None, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string").repartition(3)
    q = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and i < 300}
    want = {}
    for i in q:
        if i % 20 == 0:
            want[i] = [(j, -s) for s, j in sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]]
    for shard in (8192, 40):
        monkeypatch.setattr(kdtree, "SHARD", shard)
        got = defaultdict(dict)
        for x in kdtree.top_k(df).collect():
            got[x.query_id][x["rank"]] = (x.vec_id, x.score)
        assert {i: [g[k] for k in sorted(g)] for i, g in got.items()} == want
    assert kdtree.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in kdtree.top_k(few).collect()] == [(0, 1, 1, 8192)]


def test_top_k_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 8)
    r = random.Random(4)
    rows = [(i % 45 if i < 90 else 20, [r.choice([-0.5, 0.25, 0.5]) for _ in range(3)]) for i in range(110)]
    rows += [rows[0], rows[0]]
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = sorted((i, k, j, -s) for n, (i, v) in enumerate(q) if i % 20 == 0 for k, (s, j) in enumerate(sorted((-int(v @ w), j) for m, (j, w) in enumerate(q) if m != n)[:20], 1))
    assert sorted(map(tuple, kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())) == want


def test_pfor_blocks():
    r = np.random.default_rng(0)
    for ids in (np.array([7]), np.zeros(100), r.integers(0, 50_000, 8192), np.where(r.random(5000) < 0.03, 2**31, r.integers(100, 130, 5000)), np.array([0, 2**32 - 1])):
        ids = ids.astype(np.uint32)
        packed = tokens.pack_block(ids)
        assert np.array_equal(tokens.unpack_block(memoryview(packed)), ids)
    assert len(tokens.pack_block(np.where(np.arange(5000) % 50 == 0, 2**31, np.arange(5000) % 16).astype(np.uint32))) < 5000


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.default_tokenizer())
    extra = [(100, "It's <|endoftext|> <|STARTOFTEXT|> don't   'still, H̱x Áb ﬁne İx 12,5% ΑΣ fish,*** $$$ '"), (-4, "x" * 9000), (None, "null id")]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r) for r in df.collect())
    got = sorted(tokens.token_files(df).collect(), key=lambda r: r.start)
    start = 0
    for ((_, _, text), r), g in zip(rows, got, strict=True):
        ids = np.array(coder.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())), text[:80]
        start += len(ids)
    assert tokens.token_files(none).count() == 0


def test_token_files_of_another_tokenizer_read_in_many_tasks(spark, docs, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "RANGE", 700)
    found = tokens.token_files(docs, path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found.collect()}
    want = {}
    for r in docs.collect():
        ids = np.array(coder.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id] = (len(ids), zlib.crc32(ids.tobytes()))
    assert got == want and found.rdd.getNumPartitions() >= sum(n for n, _ in want.values()) // 700 > 4


def test_token_reader_takes_any_document():
    out = io.BytesIO()
    writer = tokens.Writer(out)
    lists = [np.arange(n, dtype=np.uint32) * 3 % 40_000 for n in (1, 9000, 1, 20_000, 5)]
    for i, x in enumerate(lists):
        writer.add(np.array([i]), np.array([False]), np.array([len(x)]), x)
    writer.close()
    reader = tokens.Reader(pa.BufferReader(out.getvalue()))
    for i in (3, 0, 4, 1, 2):
        assert np.array_equal(reader.ids(int(reader.starts[i]), int(reader.starts[i + 1])), lists[i])


def plain_components(rows: list[tuple], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, none, n, percent):
    want = plain_components(corpus(), n, percent)
    got = ngram_join.join(docs, n, percent).collect()
    assert len(got) == docs.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.join(none, n, percent).count() == 0


def test_ngram_join_finds_links_past_the_head_of_a_tile(spark):
    """A chain of copies in which each differs a little more from the first; links lie between neighbours only."""
    base = [f"w{i}" for i in range(200)]
    rows, now = [], list(base)
    for i in range(12):
        rows.append((100 - i, " ".join(now)))
        now = list(now)
        now[15 * i + 3] = f"x{i}"
        now[15 * i + 9] = f"y{i}"
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 3, 90).items()} and len(set(got.values())) == 1


def test_ngram_join_tests_pairs_in_rounds(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOVED", 0.1)
    got = ngram_join.join(docs, 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(corpus(), 5, 80)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(3)
    for n in (3, 50, 900):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 3 :], r.integers(0, 2**63, n // 5 + 1, dtype=np.uint64)]))
        x, y = ngram_join.bitmaps([a, b])
        least = min(len(x), len(y))
        assert int(np.bitwise_count(ngram_join.folded(x, least) ^ ngram_join.folded(y, least)).sum()) <= len(np.setxor1d(a, b))


def test_suffix_array():
    r = np.random.default_rng(1)
    for trial in range(150):
        t = r.integers(0, int(r.integers(1, 6)), int(r.integers(1, 400))).astype(np.uint8)
        t = np.tile(t[: max(1, len(t) // 7)], 8) if trial % 3 == 0 else t
        b = t.tobytes()
        want = sorted(range(len(t)), key=lambda i: b[i:])
        sa = sais.suffix_array(t)
        assert sa.tolist() == want
        shared = sais.permuted_prefixes(t, sa)
        for i, j in zip(want[1:], want, strict=False):
            same = next((k for k in range(len(b)) if b[i + k : i + k + 1] != b[j + k : j + k + 1] or i + k >= len(b)), 0)
            assert shared[i] == same


@pytest.mark.parametrize("part", [100, 1 << 15])
def test_minimizer_runs(monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    r = np.random.default_rng(4)
    sizes = [0, 49, 50, 51, 0, 700, 10, 300, 120]
    buf, off = r.integers(97, 101, sum(sizes)).astype(np.uint8), np.concatenate(([0], np.cumsum(sizes)))
    buf[off[5] + 200 : off[5] + 300] = buf[off[7] + 50 : off[7] + 150]
    runs = list(zip(*(x.tolist() for x in suffix_dedup.minimizer_runs(buf, off)), strict=True))
    starts = [(row, i) for row, n in enumerate(sizes) for i in range(int(off[row]), int(off[row]) + n - 49)]
    assert [(row, i) for row, a, z, _, _ in runs for i in range(a, z + 1)] == starts
    pieces, windows = {}, {}
    for _, a, z, place, h in runs:
        assert pieces.setdefault(buf[place : place + 24].tobytes(), h) == h and z <= place <= a + 26
        for i in range(a, z + 1):
            assert windows.setdefault(buf[i : i + 50].tobytes(), (place - i, h)) == (place - i, h)


def test_suffix_array_is_given_only_fragments_that_have_their_minimizer_in_common(monkeypatch):
    r = np.random.default_rng(5)
    texts = [r.integers(97, 101, 400).astype(np.uint8) for _ in range(6)]
    texts[3][100:260], texts[4][30:190] = texts[0][50:210], texts[1][0:160]
    texts += [texts[2], texts[2], texts[0]]
    pieces, size, low, high, pivot = [], [], [], [], []
    for i, t in enumerate(texts):
        for _, a, z, place, _ in zip(*suffix_dedup.minimizer_runs(t, np.array([0, 400])), strict=True):
            pieces.append(t[a : z + 50])
            size.append(len(pieces[-1]))
            low.append(i)
            high.append(i + i % 2)
            pivot.append(place - a)
    given = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t: given.append(len(t)) or sais.suffix_array(t))
    f, a, z, m = (x.tolist() for x in suffix_dedup.lost_runs(np.concatenate(pieces), *(np.array(x) for x in (size, low, high, pivot))))
    first: dict[bytes, int] = {}
    for p, i in zip(pieces, low, strict=True):
        for k in range(len(p) - 49):
            first.setdefault(p[k : k + 50].tobytes(), i)
    want = {(j, k): first[p[k : k + 50].tobytes()] for j, p in enumerate(pieces) for k in range(len(p) - 49) if first[p[k : k + 50].tobytes()] < high[j]}
    assert {(j, k): v for j, x, y, v in zip(f, a, z, m, strict=True) for k in range(x, y + 1)} == want
    assert 0 < sum(given) < sum(len(p) + 1 for p in {p.tobytes(): p for p in pieces}.values()) / 4


def plain_removal(rows: list[tuple]) -> dict[int, tuple]:
    owner: dict[bytes, int] = {}
    texts = sorted(((i, (t or "").encode()) for i, t, *_ in rows if i is not None))
    for i, b in texts:
        for p in range(len(b) - 49):
            owner.setdefault(b[p : p + 50], i)
    out = {}
    for i, b in texts:
        lost = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner[b[p : p + 50]] < i:
                lost[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(b, lost, strict=True) if not x)
        out[i] = (len(b), sum(lost), len(re.findall(rb"\x01+", bytes(lost))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, none, monkeypatch):
    rows = corpus() + [(200, "ab" * 400, *corpus()[0][2:]), (201, "x" + "ab" * 90 + "é" * 60, *corpus()[0][2:]), (202, "é" * 49, *corpus()[0][2:])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_removal(rows)
    for size in (1 << 20, 3000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        got = suffix_dedup.dedup(df).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.dedup(none).count() == 0


def test_suffix_dedup_rows_that_share_an_id(spark):
    r = np.random.default_rng(8)
    a, b, c = (" ".join(f"{w:x}" for w in r.integers(0, 1 << 30, 60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, c + a[100:200]), (5, b), (7, b)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = [len(x) for x in (a, b, c)]
    assert got == sorted([(1, n[0], 0, 0), (5, n[0], n[0], 1), (5, n[1], 0, 0), (5, n[1], 0, 0), (5, n[2] + 100, 100, 1), (7, n[1], n[1], 1)])


def test_chained_passages(spark, docs, none):
    found = chaining.passages(docs).collect()
    texts = {i: words(t) for i, t, *_ in corpus()}
    up = {i: i for i in texts}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        assert r.n_words >= 50 and r.n_matches >= 0.8 * r.n_words and r.doc_id != r.match_doc_id
        a, b = texts[r.doc_id][r.begin_word : r.end_word], texts[r.match_doc_id][r.match_begin : r.match_end]
        assert max(len(a), len(b)) == r.n_words and chaining.edit_matches(*([hash(x) for x in y] for y in (a, b))) >= r.n_matches
        up[top(r.doc_id)] = top(r.match_doc_id)
    holders = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(i)
    repeated = [s for s in holders.values() if len(s) > 1]
    assert repeated and all(len({top(x) for x in s}) == 1 for s in repeated)
    reported = {r.doc_id for r in found} | {r.match_doc_id for r in found}
    assert {i for i in texts if i % 6 in (3, 4, 5) and i > 6 or i < 7}.isdisjoint(reported)
    assert chaining.passages(none).count() == 0


def test_segments_of_matches_that_go_on():
    r = np.random.default_rng(12)
    for _ in range(40):
        n = int(r.integers(0, 200))
        w, d, units = r.integers(0, 3, n), r.integers(0, 3, n), r.integers(0, 9, n) * r.integers(0, 2, n)
        p = r.integers(0, 400, n)
        q = p + r.integers(0, 3, n)
        # each unit by itself: the seed's own place, and the runs of words behind it
        places: dict[tuple, dict[int, bool]] = {}
        for row, other, a, b, k in zip(*(x.tolist() for x in (w, d, p, q, units)), strict=True):
            own = places.setdefault((row, other, b - a), {})
            for step in range(k + 1):
                at = a + step * chaining.GRAM + (step > 0)
                own[at] = own.get(at, False) or step == 0
        want = []
        for (row, other, diagonal), own in places.items():
            run: list[int] = []
            for at in [*sorted(own), None]:
                if run and (at is None or at - run[-1] > chaining.MERGE):
                    want.append((row, other, run[0], run[-1] + chaining.GRAM, run[0] + diagonal, sum(own[x] for x in run)))
                    run = []
                run.append(at)
        got = chaining.segments(w, p, d, q, p + units * chaining.GRAM + (units > 0))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def plain_grown(a: list[int], b: list[int], wide: int) -> tuple:
    a, b, low = a[:wide], b[:wide], -(1 << 30)
    at = lambda v, i, none: v[i] if 0 <= i < len(v) else none
    cells = {k: (chaining.DIFFER * k if k >= 0 else low, 0) for k in range(-chaining.BAND, chaining.BAND + 1)}
    best, live = (0, 0, 0, 0), True
    for i in range(wide):
        new = {}
        for k in cells:
            same = at(a, i, -1) == at(b, i + k, -2)
            ways = [(cells[k][0] + (chaining.AGREE if same else chaining.DIFFER), cells[k][1] + same)]
            ways += [(c[k + s][0] + chaining.DIFFER, c[k + s][1]) for c, s in ((cells, 1), (new, -1)) if k + s in c]
            new[k] = max(ways, key=lambda v: v[0])
        cells = new
        k = max(cells, key=lambda k: cells[k][0])
        if cells[k][0] > best[0]:
            best = (cells[k][0], i + 1, i + 1 + k, cells[k][1])
        if cells[k][0] <= best[0] - chaining.DROP:
            live = False
            break
    return (*best[1:], live)


@pytest.mark.parametrize("wide", [20, 64, 200])
def test_ends_grow_as_by_plain_alignment(wide):
    r = np.random.default_rng(13)
    xs, ys = [], []
    for _ in range(150):
        a = r.integers(0, int(r.integers(2, 40)), int(r.integers(0, 120)))
        b = np.where(r.random(len(a)) < r.choice([0, 0.05, 0.1, 0.3]), -r.integers(1, 9, len(a)) + 60, a)
        b = np.delete(b, r.integers(0, len(b), int(r.integers(0, 4)))) if len(b) else b
        xs.append(a.astype("<u4"))
        ys.append(b.astype("<u4"))
    got = list(zip(*(x.tolist() for x in chaining.grown(xs, ys, wide)), strict=True))
    assert got == [plain_grown(a.tolist(), b.tolist(), wide) for a, b in zip(xs, ys, strict=True)]


def test_chained_passages_words_in_small_batches(spark, docs, monkeypatch):
    want = sorted(chaining.passages(docs).collect())
    monkeypatch.setattr(chaining, "FETCH", 100)
    assert want and sorted(chaining.passages(docs).collect()) == want


def test_chains_skip_gaps_and_keep_order():
    (score, path), *rest = chaining.chains([0, 10, 12, 30], [8, 18, 20, 40], [100, 112, 5, 133])
    assert path == [0, 1, 3] and score == pytest.approx(26 - chaining.GAP * (2 + 4 + 12 + 13)) and [p for _, p in rest] == [[2]]


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_chained_passages_behind_other_holders(spark, monkeypatch, size):
    monkeypatch.setattr(chaining, "SLICE", size)
    own = lambda i, n: " ".join(f"d{i}x{k}" for k in range(n))
    passage = [f"p{k}" for k in range(60)]
    texts = {i: f"{own(i, 30)} {' '.join(passage[:n])} {own(-i, 30)}" for i, n in ((5, 49), (10, 60), (20, 49), (30, 60))}
    found = chaining.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert (30, 30, 90, 10, 30, 90, 60, 60) in {tuple(r) for r in found}


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_chained_passages_at_every_place(spark, monkeypatch, size):
    monkeypatch.setattr(chaining, "SLICE", size)
    own = lambda i, n: " ".join(f"d{i}x{k}" for k in range(n))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"{own(1, 30)} {passage}"), (2, f"{own(2, 30)} {passage} {own(3, 30)} {passage} {own(4, 30)}")]
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.begin_word, r.end_word, r.match_begin) for r in found if r.doc_id == 2} == {(30, 90, 30), (120, 180, 30)}


def test_workers_give_freed_memory_back(spark, monkeypatch, tmp_path):
    from lodestone.llm import frames

    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    def over(batches):
        arrays = [np.ones(1 << 13) for _ in batches]  # below the size that allocators map apart
        yield (held(), arrays.pop())

    top, last = next(work := frames.freed(over)(range(4000)))
    assert next(work, None) is None and len(last) and held() < top - (100 << 20)
    # every step in Python of the near-copy join does so
    calls = str(tmp_path / "calls")

    def mark():
        with open(calls, "a") as f:
            f.write("x")

    monkeypatch.setattr(frames, "give_back", mark)
    rows = spark.createDataFrame([(i, f"{i % 3} b c d e f g h i j {i}") for i in range(12)], "doc_id long, text string")
    ngram_join.join(rows).collect()
    assert len(Path(calls).read_text()) >= 6


@pytest.mark.parametrize("keep", [1, 4])
def test_chained_passages_of_seeds_in_many_contexts(spark, monkeypatch, keep):
    """Every seed of the passage stands in more than KEEP other contexts of each slice, and smaller ids hold them all."""
    monkeypatch.setattr(chaining, "KEEP", keep)
    passage = [f"p{k}" for k in range(60)]
    filler = lambda i: " ".join(f"{' '.join(passage[k : k + 7])} " + " ".join(f"f{i}x{k}x{j}" for j in range(4)) for k in range(54))
    own = lambda i: " ".join(f"d{i}x{k}" for k in range(30))
    rows = [(i, filler(i)) for i in range(240)]
    rows[150], rows[230] = (1000, f"{own(1)} {' '.join(passage)}"), (1001, f"{own(2)} {' '.join(passage)} {own(3)}")
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.match_doc_id, r.begin_word, r.end_word, r.match_begin) for r in found} >= {(1001, 1000, 30, 90, 30), (1000, 1001, 30, 90, 30)}


def test_places_meet_the_holder_alike_for_longest_through_trees():
    """Of places of one seed in several slices, some of one id: the deepest node is that of the most units alike."""
    r = np.random.default_rng(5)
    for ids in (np.arange(40), np.arange(40) % 17):
        of, doc = np.repeat(np.arange(8), 5), ids
        context = sum((r.integers(0, 3, 40).astype(np.uint64) << np.uint64(8 * k)) for k in range(8))
        h, pos = np.full(40, 12345, np.uint64), np.arange(40)
        found = chaining.nodes(h, context, pos % 5, pos, doc, of)
        assert not any(chaining._heads(found[0], found[5]) ^ True)
        order = np.lexsort((found[5], found[4], found[0]))
        key, level, who, p, d, o = (x[order] for x in found)
        me, to = chaining.holders(key, d, o)
        assert (o[me] != o[to]).all() and (key[me] == key[to]).all()
        for s in range(8):
            m = o[me] == s
            deep = [x[m] for x in (key[me], level[me], who[me], p[me], d[to], p[to])]
            mine = np.flatnonzero(of == s)
            local = [x[mine] for x in (h, context, pos % 5, pos)]
            got = {x: 0 for x in mine.tolist()}
            for x, other, q, units in zip(*(v.tolist() for v in [c for i, c in enumerate(chaining.deepest(doc[mine], local, deep)) if i]), strict=True):
                assert doc[q] == other != doc[x] and of[q] != s and chaining.alike(context[x : x + 1], context[q : q + 1])[0] >= units
                got[x] = max(got[x], units)
            for x in mine.tolist():
                rest = np.flatnonzero((of != s) & (doc != doc[x]))
                assert got[x] == chaining.alike(np.full(len(rest), context[x]), context[rest]).max()


def test_edit_matches_are_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(60):
        x, y = ([r.randrange(5) for _ in range(r.randrange(90))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            last = 0
            for j, b in enumerate(y):
                row[j + 1], last = max(row[j], row[j + 1], last + (a == b)), row[j + 1]
        assert chaining.edit_matches(x, y) == row[-1]


def test_chains_of_many_segments_are_cut_without_recursion():
    x = np.arange(60_000, dtype=np.uint32)
    y = np.where(np.arange(60_000) % 40 < 8, x, x + np.uint32(100_000))
    begin = list(range(0, 60_000, 40))
    work = chaining._Work((1, 0, 0, 0), (x, y), (True, True), begin, [b + 8 for b in begin], list(begin))
    assert chaining.aligned([work]) == ([], [])


def edited(passage: list[str], rate: float | int, r: random.Random) -> list[str]:
    """Every rate-th word changed, or that share of the words by chance changed, left out or doubled by a new one."""
    out = []
    for k, w in enumerate(passage):
        new = f"n{r.randrange(10**9)}"
        if rate >= 1:
            out.append(new if k % int(rate) == rate // 2 else w)
        elif r.random() >= rate:
            out.append(w)
        else:
            out += r.choice([[new], [new], [], [w, new]])
    return out


def plain_similarity(x: list[str], y: list[str]) -> float:
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            row[j + 1], last = max(row[j], row[j + 1], last + (a == b)), row[j + 1]
    return row[-1] / max(len(x), len(y))


def test_chained_passages_recall(spark):
    """Of edited passages that a quadratic alignment finds similar enough, at least 0.9 are found, by most of their words."""
    r = random.Random(11)
    own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], {}
    for rate in (0.05, 0.1, 0.15, 0.18, 5, 6, 7, 8):
        for size in (100, 200):
            for _ in range(25):
                a = [f"p{r.randrange(10**9)}" for _ in range(size)]
                b = edited(a, rate, r)
                i = len(rows)
                rows += [(i, " ".join(own(40) + a + own(40))), (i + 1, " ".join(own(60) + b + own(20)))]
                if plain_similarity(a, b) >= 0.8:
                    planted[i + 1] = (rate, size)
    best = defaultdict(int)
    for x in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        assert {x.doc_id, x.match_doc_id} in ({x.doc_id, x.doc_id + 1}, {x.doc_id, x.doc_id - 1})
        best[max(x.doc_id, x.match_doc_id)] = max(best[max(x.doc_id, x.match_doc_id)], x.n_words)
    found = [best[i] >= 0.6 * size for i, (_, size) in planted.items()]
    assert len(found) > 300 and sum(found) >= 0.9 * len(found)
    by = defaultdict(list)
    for i, k in planted.items():
        by[k].append(best[i] > 0)
    print({k: f"{sum(v)}/{len(v)}" for k, v in by.items()})
    assert all(sum(v) >= 0.8 * len(v) for v in by.values())


def plain_leaks(docs: dict[int, list[str]], items: dict[int, list[str]]) -> dict[tuple[int, int], str]:
    """Leaks by trying every window of every item at every place of every document, from tokens with their signs."""
    sign = lambda t: ord(t[0]) if t[0] < "\x05" else 0
    word = lambda t: t[1:] if sign(t) else t

    def meet(a: list[str], b: list[str]) -> bool:
        fixed = sum(sign(t) in (1, 2) for t in a)
        if fixed > len(a) - decontaminate.LITERALS:
            return list(map(word, a)) == list(map(word, b))
        for names in ((3, 4), (3,), ()):
            masked, same = 0, True
            for x, y in zip(a, b, strict=True):
                if sign(y) in (1, 2):
                    same &= sign(x) == sign(y)
                elif sign(y) in names:
                    same &= sign(x) in (3, 4)
                    masked += 1
                else:
                    same &= sign(x) not in (1, 2) and word(x) == word(y)
            if same and masked + fixed <= len(a) - decontaminate.LITERALS:
                return True
        return False

    out = {}
    for d, toks in docs.items():
        for i, own in items.items():
            n, w = len(own), min(len(own), decontaminate.WINDOW)
            if not n:
                continue
            if n < decontaminate.LITERALS:
                at = [(0, 0)] if list(map(word, own)) == list(map(word, toks)) else []
            else:
                at = [(p, q) for p in range(n - w + 1) for q in range(len(toks) - w + 1) if meet(own[p : p + w], toks[q : q + w])]
            pairs = {(q + k, p + k) for p, q in at for k in range(w)}
            if len({p for _, p in pairs}) < decontaminate.COVER * n or not pairs:
                continue
            kind = lambda t: {1: "n", 2: "u", 3: "c", 4: "c"}.get(sign(t))
            by = defaultdict(set)
            for q, p in pairs:
                x, y = own[p], toks[q]
                lower = sign(x) == 4 and word(x) in own
                if kind(x) and not lower and kind(x) == kind(y):
                    by[q - p].add((p, kind(x), word(x), word(y)))
            fits = []
            for held in by.values():
                three = {(k, x, y) for _, k, x, y in held}
                if len({(k, x) for k, x, _ in three}) == len(three) == len({(k, y) for k, _, y in three}):
                    fits.append(sum(x != y for _, _, x, y in held))
            if fits or not by:
                out[(d, i)] = "reparameterised" if fits and min(fits) else "verbatim"
    return out


def test_decontaminate_equals_brute_force(spark, monkeypatch):
    r = random.Random(21)
    names, nouns = ["Tom", "Anna", "Paris", "Bob", "Rome"], ["apples", "pears", "trains", "books"]
    frames = [
        "{a} has {x} {n} and gives {y} of them to {b} who then has {z} more than before.",
        "The {n} cost {x} dollars each. {a} buys {y} of them in {c}. How much does {a} pay?",
        "{a} buys {x} {n}. {b} buys {y}. {a} and {b} eat {z}. How many are left?", "Compute {x} + {y} = {z}", "{x} {y} {z} {x} {y} 4 5 6 7", "{n} only", "{n}",
    ]
    fill = lambda f: f.format(a=r.choice(names), b=r.choice(names), c=r.choice(names), n=r.choice(nouns), x=r.randint(1, 9), y=r.randint(1, 9), z=r.randint(1, 9))
    items = [(i, fill(frames[i % len(frames)])) for i in range(28)] + [(100, None), (101, "")]
    noise = lambda: " ".join(r.choice([*names, *nouns, "has", "the", "and", "3", "4 km", "buys", "of them."]) for _ in range(r.randint(0, 12)))
    docs = []
    for d in range(120):
        t = fill(r.choice(frames)) if r.random() < 0.6 else r.choice(items[:28])[1]
        t = t.lower() if r.random() < 0.2 else t
        docs.append((d, t if r.random() < 0.2 else f"{noise()} {t} {noise()}"))
    docs += [(500, None), (501, "")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    read = lambda df, i: {x[0]: list(x[1]) for x in df.filter("text is not null").select(i, decontaminate.tokens(F.col("text"))).collect()}
    want = plain_leaks(read(d, "doc_id"), read(b, "item_id"))
    assert len(want) > 60 and set(want.values()) == {"verbatim", "reparameterised"}
    for hot in (decontaminate.HOT, 1):
        monkeypatch.setattr(decontaminate, "HOT", hot)
        assert {(x.doc_id, x.item_id): x.kind for x in decontaminate.leaks(d, b).collect()} == want
