from __future__ import annotations

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, corpus, plain_components


def test_near_copies_leave_one(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    want = {i for i, (_, c) in plain_components(corpus(), 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_mixed_rows_are_those_taken(spark):
    from lodestone.llm import mixing

    df = spark.createDataFrame(corpus(), SCHEMA)
    out = corpus_pipeline.mix_sources(spark, df, "")
    assert out.columns == df.columns
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r.doc_id] = max(taken.get(r.doc_id, 0), r.copies)
    have = {}
    for r in out.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    rows = {i: sum(x[0] == i for x in corpus()) for i in taken}
    assert have == {i: n * rows[i] for i, n in taken.items() if n}


def test_run_on_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts and starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_an_empty_table_goes_through(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, "/root/testdata/sf0.001")
        assert out.columns == none.columns and out.count() == 0
        none = out
    assert corpus_pipeline.STAGES[-1][1](spark, none, "/root/testdata/sf0.001").count() == 0


def test_every_stage_by_plain_means(spark, tmp_path):
    """All stages over a table with clashing names, nulls, repeats and planted cases, each against a plain version on its own input."""
    import zlib
    from collections import Counter

    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from lodestone.llm import decontaminate, mixing, tokens, toxicity
    from tests.llm.test_operators import plain_leaks, words

    sf_dir = "/root/testdata/sf0.001"
    names = ["score", "copies", "k", "d", "salt", "leaked_doc", "toxicity_score"]
    bench = [x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(20).collect()]
    docs = [(x.doc_id, x.text, x.lang, x.source) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    top = max(x[0] for x in docs)
    docs += [(top + 1 + i, f"before it {b} and behind it", "en", "s") for i, b in enumerate(bench)]
    docs += [(None, "a row without a number", None, None), (top + 90, None, "en", "s"), (top + 91, "", None, None), (top + 95, "a text of an id", "zz", "s"), (top + 95, "and another text of it", None, "s"), docs[5]]
    table = spark.createDataFrame([(*x, len(x[1] or ""), *names) for x in docs], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(5)
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = lambda df: Counter((x.doc_id, x.text, x.source) for x in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    def out(name, docs):
        path = str(tmp_path / name)
        got = stages[name](spark, docs, sf_dir)
        assert got.columns == docs.columns
        got.write.parquet(path)
        return spark.read.parquet(path)

    clean = out("toxicity", table)
    net = toxicity.learn(table, labels)
    limits = toxicity.Network.unpack(net).thresholds
    scores = {(x.doc_id, x.text): x.score for x in table.select("doc_id", "text").join(toxicity.score(table.filter(F.col("doc_id") != top + 95), net), "doc_id").collect()}
    want = rows(table)
    lang = {(x[0], x[1]): x[2] for x in docs}
    got = rows(clean)
    assert all((k in got) == (scores[k[:2]] < limits.get(lang[k[:2]], toxicity.CUT)) for k in want if k[:2] in scores)
    assert got[(None, "a row without a number", None)] == 1 and not got - want

    single = out("ngram_jaccard_join", clean)
    texts = {}
    for x in clean.filter("doc_id is not null").collect():
        texts.setdefault(x.doc_id, x.text)
    twice = {i for i, n in Counter(x[0] for x in set(got)).items() if n > 1}
    groups = plain_components([(i, t) for i, t in texts.items() if i not in twice], 5, 80)
    kept = {x.doc_id for x in single.collect()}
    assert None in kept and kept - {None} - twice == {i for i, (_, c) in groups.items() if i == c}

    free = out("decontamination", single)
    read = lambda df, i: {x[0]: list(x[1]) for x in df.select(i, decontaminate.tokens(F.col("text"))).collect()}
    gone = {k for k in rows(single)} - set(rows(free))
    held = {k for k in rows(single) if k[0] is not None and any(b.text and len(b.text) > 20 and b.text in (k[1] or "") for b in items.collect())}
    assert len(held) >= 10 and held <= gone and not rows(free) - rows(single)
    ids = [k[0] for k in gone - held]
    left = read(single.filter(F.col("doc_id").isin(ids)), "doc_id")
    assert {d for d, _ in plain_leaks(left, read(items, "item_id"))} == set(left)

    mixed = out("mixing", free)
    copies = {}
    for x in mixing.mix(free).collect():
        copies[x.doc_id] = max(copies.get(x.doc_id, 0), x.copies)
    assert rows(mixed) == Counter({k: n * copies[k[0]] for k, n in rows(free).items() if copies[k[0]]})
    for source in {k[2] for k in rows(free)}:
        size = sum(len(words(k[1])) * n for k, n in rows(free).items() if k[2] == source)
        assert sum(len(words(k[1])) * n for k, n in rows(mixed).items() if k[2] == source) <= 3 * size

    ends = stages["token_output"](spark, mixed, sf_dir).orderBy("start").collect()
    coder, at = Tokenizer.from_file(tokens.default_tokenizer()), 0
    ordered = sorted(((k[0] is not None, k[0] or 0, k[1] or "") for k in rows(mixed).elements()))
    for (_, _, text), x in zip(ordered, ends, strict=True):
        ids = coder.encode(text, add_special_tokens=False).ids + [2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
