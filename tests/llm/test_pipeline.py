"""The pipeline against its operators, stage by stage, and on planted documents."""

import random

import corpus_pipeline
from framelake.llm import decontamination, secrets, simhash
from framelake.llm.common import table


def firsts(texts):
    """The smallest id of each near-duplicate class, by brute force over all fingerprints."""
    before = {d: simhash.fingerprint(t, corpus_pipeline.SHINGLE) for d, t in texts.items()}
    ids = sorted(before)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (before[a] ^ before[b]).bit_count() <= corpus_pipeline.BITS and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(d) for d in ids}


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen.append((name, {r.doc_id: r for r in docs.collect()}))
        assert docs.columns[:len(columns)] == columns
        assert name == "source_mix" or docs.columns == columns
    rows = dict(seen)
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    kept = [labels[d] for d in rows["quality_classifier"] if d in labels]
    good = [r for r in labels.values() if r.quality == 1 and r.toxic == 0]
    assert sum(r.quality == 0 for r in kept) <= 0.1 * sum(r.quality == 0 for r in labels.values())
    assert sum(r.quality == 1 and r.toxic == 0 for r in kept) >= 0.95 * len(good)
    items = [t.lower().encode().split() for t in (r.text for r in table(spark, sf, "benchmark").collect())]
    for r in rows["benchmark_decontamination"].values():
        words = r.text.lower().encode().split()
        assert not any(b" ".join(i) in b" ".join(words) for i in items)
    assert set(rows["simhash_near_dedup"]) == firsts({d: r.text for d, r in rows["quality_classifier"].items()})
    scanner = secrets.NoveltyScanner()
    for d, r in rows["secret_scans"].items():
        assert not scanner.base(r.text) and r.n_chars == len(r.text)
        assert r.text == rows["benchmark_decontamination"][d].text or "<secret>" in r.text
    assert all(r.copies in (1, 2) for r in rows["source_mix"].values())


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, docs.collect())) == sorted(map(str, rows))


def test_near_copies_and_leaks_are_caught(spark, sf):
    rng = random.Random(8)
    base = [f"{rng.choice(['the', 'of', 'and'])}{rng.randrange(5000)}" for _ in range(400)]
    copies = []
    for _ in range(20):
        words = list(base)
        for at in rng.sample(range(400), 4):
            words[at] = "changed"
        copies.append(" ".join(words))
    item = table(spark, sf, "benchmark").first().text
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(copies)] + [(100, " ".join(base[::-1]) + " " + item, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert left == firsts({r[0]: r[1] for r in rows}) and 100 in left and len(left) < 21
    assert {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, sf).collect()} == set(range(20))
    assert decontamination.COVERAGE == 0.5


def test_odd_and_empty_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 5000, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.collect()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_groups_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents").cache()
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert left == firsts({r.doc_id: r.text for r in docs.collect()})


def test_a_large_group_keeps_one(spark, sf):
    texts = [" ".join(f"w{i}" for i in range(600)) + f" end{k % 50}" for k in range(3000)]
    left = corpus_pipeline.near_dedup(spark, frame(spark, texts), sf)
    assert {r.doc_id for r in left.collect()} == firsts(dict(enumerate(texts[:50])))


def test_equal_ids_and_clashing_columns(spark, sf):
    """Of equal ids one row stays, the same in every run and partitioning; all columns are passed on."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, c, "x", 1, "y") for c in "abcab"] + [(None, text + " more", "a", "x", 1, "y"), (None, "another", "a", None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, first_id string, keep_id string, place long, __row0 string")
    kept = [sorted(map(str, corpus_pipeline.near_dedup(spark, docs.repartition(n), sf).collect())) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2 and sum("'another'" in r for r in kept[0]) == 1
    assert corpus_pipeline.near_dedup(spark, docs, sf).columns == docs.columns
