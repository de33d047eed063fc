"""The word-pair model against a plain one, and what its bands reject."""

import math
import random
import tempfile
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from framelake import workspace
from framelake.llm import kneser_ney, perplexity
from framelake.llm.common import table


def plain_scores(rows):
    """Score of each (text, lang), by dictionaries; counts of the text and its copies taken off."""

    def pairs_of(text):
        found = ["", *kneser_ney.words_of(text)]
        return Counter(zip(found, found[1:]))

    out = []
    for text, lang in rows:
        whole = Counter()
        for other, its in rows:
            if its == lang:
                whole.update(pairs_of(other or ""))
        left = Counter()
        for other, its in rows:
            if its == lang and (other or "") != (text or ""):
                left.update(pairs_of(other or ""))
        before = Counter(w for _, w in whole)
        high = kneser_ney.discounts(kneser_ney.counts_of_counts(np.array(list(whole.values()))))
        low = kneser_ney.discounts(kneser_ney.counts_of_counts(np.array(list(before.values()))))
        rest = sum(low[min(n, 3)] for n in before.values())
        own, total = pairs_of(text or ""), 0.0
        for (u, w), times in own.items():
            after = sum(1 for pair in left if pair[1] == w)
            lower = (max(after - low[min(after, 3)], 0) + rest / (len(before) + 1)) / len(whole)
            context = sum(n for pair, n in left.items() if pair[0] == u)
            p = lower
            if context:
                held = sum(high[min(n, 3)] for pair, n in left.items() if pair[0] == u)
                p = (max(left[u, w] - high[min(left[u, w], 3)], 0) + held * lower) / context
            total -= times * math.log(p)
        out.append(total / own.total() if own else None)
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 60, "entries": 16, "at_once": 5}])
def test_scores_equal_a_plain_model(spark, sizes):
    draw = random.Random(5)
    names = [f"w{i}" for i in range(12)] + ["été", "猫"]
    rows = [(" ".join(draw.choices(names, range(1, 15), k=draw.randint(1, 30))), draw.choice(["a", "b", None])) for _ in range(40)]
    rows += [rows[0]] * 3 + [(None, "a"), ("", "b"), (" .,", None), ("odd words only here", "c")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    found = {r.id: r.score for r in kneser_ney.perplexity(docs.repartition(3), **sizes).collect()}
    for i, want in enumerate(plain_scores(rows)):
        assert found[i] == (want if want is None else pytest.approx(want, rel=1e-9)), rows[i]


def test_model_is_a_distribution():
    """Over all words that may open a text, and one share for unseen words, probabilities add up to one."""
    draw = random.Random(2)
    names = [f"w{i}" for i in range(50)]
    block = kneser_ney.Block()
    for text in [" ".join(draw.choices(names, range(1, 51), k=20)) for _ in range(30)] + names:
        block.add(0, "en", text, ())
    pairs = kneser_ney.Pairs(block.row().to_pylist()[0])
    words, found = kneser_ney.word_statistics(pairs.keys, pairs.counts)
    stats = found[:, np.searchsorted(words, pairs.hashes)]
    after = stats[4]
    n = kneser_ney.counts_of_counts(after)
    sums = {0: (kneser_ney.counts_of_counts(pairs.counts), [*n, int((after >= 3).sum()), int(after.sum()), int((after > 0).sum())])}
    scores = kneser_ney.scores(pairs, pairs.counts, stats, sums, np.zeros(80, np.int64), 7)
    high, low = kneser_ney.discounts(sums[0][0]), kneser_ney.discounts(n)
    start = stats[:, 0]  # the start of texts is the first word of the list
    unseen = high[1:] @ start[1:4] / start[0] * (low[np.minimum(after, 3)].sum() / (len(names) + 1)) / after.sum()
    assert np.exp(-scores[30:]).sum() + unseen == pytest.approx(1)


def test_counts_cover_all_texts(spark, sf):
    docs = table(spark, sf, "documents")
    blocks, _ = kneser_ney.blocks_of(docs, lambda text: ())
    sent = kneser_ney._send_pairs(blocks, 3).collect()
    found = sum(int(kneser_ney.unpack(r["counts"], "<u4").sum()) for r in sent)
    assert found == sum(len(kneser_ney.words_of(r.text or "")) for r in docs.collect())


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) >> np.uint64(1))
        assert (kneser_ney.unpack_pairs(kneser_ney.pack_pairs(keys)) == keys).all()
        assert (kneser_ney.unpack(kneser_ney.pack(keys, "<u8"), "<u8") == keys).all()


def test_a_pair_is_sent_once_a_block(spark):
    docs = spark.createDataFrame([(i, "the same few words again and again", "en") for i in range(500)],
                                 "doc_id long, text string, lang string").coalesce(1)
    blocks, _ = kneser_ney.blocks_of(docs, lambda text: ())
    rows = kneser_ney._send_pairs(blocks, 1).collect()
    assert len(rows) == blocks.count() and all(len(kneser_ney.unpack_pairs(r["keys"])) == 7 for r in rows)


def test_shuffled_words_stand_out(spark, sf):
    """Long documents with their words shuffled, or judged as another language, fall outside the band."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    good = table(spark, sf, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    some = docs.join(good, "doc_id").filter("size(split(text, ' ')) > 200").orderBy("doc_id").limit(40).collect()
    draw = random.Random(3)
    rows = []
    for r in some:
        words = r.text.split()
        draw.shuffle(words)
        rows.append((-1 - r.doc_id, " ".join(words), r.lang))
        rows.append((-100_000_000 - r.doc_id, r.text, "fr" if r.lang != "fr" else "en"))
    scores = {r.doc_id: r.score for r in perplexity.score_documents(
        docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()}
    assert all(scores[-1 - r.doc_id] > scores[r.doc_id] for r in some)
    assert sum(scores[-100_000_000 - r.doc_id] > scores[r.doc_id] for r in some) >= 0.9 * len(some)


def test_a_word_goes_along_to_a_row_and_a_column(spark):
    """Its hash is sent with the pairs of each range, so it must not go to all of them."""
    rng = random.Random(31)
    text = " ".join(f"w{rng.randrange(60)}" for _ in range(20_000))
    pairs = len(set(zip(["", *text.split()], text.split())))
    blocks, _ = kneser_ney.blocks_of(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), lambda text: ())
    sent = kneser_ney._send_pairs(blocks, 36).collect()
    keys = [kneser_ney.unpack_pairs(r["keys"]) for r in sent]
    assert len(sent) == 36 and len(np.unique(np.concatenate(keys))) == sum(map(len, keys)) == pairs
    words = [set((k >> np.uint64(32)).tolist()) | set((k & np.uint64(0xFFFFFFFF)).tolist()) for k in keys]
    assert max(sum(word in own for own in words) for word in set.union(*words)) <= 6 + 6 - 1
    for ranges in (1, 2, 3, 7, 38):
        found = kneser_ney._send_pairs(blocks, ranges).collect()
        assert len({r["range"] for r in found}) >= ranges and sum(len(kneser_ney.unpack_pairs(r["keys"])) for r in found) == pairs


def test_shuffles_are_deleted_with_their_step(spark):
    """Else shuffle files of a step lie about until the driver collects its garbage."""
    folder, key = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    stored = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    rows, before, held = spark.range(1000).repartition(3, "id"), spark.conf.get(key, None), stored()
    untidy = workspace.materialize(rows, "untidy")
    left = stored() - held
    tidy = workspace.materialize(rows, "tidy", tidy=True)
    assert left and not stored() - held - left and spark.conf.get(key, None) == before
    assert tidy.count() == untidy.count() == 1000


def block_of(texts):
    block = kneser_ney.Block()
    for i, (text, lang) in enumerate(texts):
        block.add(i, lang, text, ())
    return block.row().to_pylist()[0]


def test_pairs_of_a_block_take_little_memory():
    """A task holds its block beside that of another one; it was stopped at over 3 GB of an executor."""
    draw = random.Random(8)
    names = [f"w{i}" for i in range(3000)]
    row = block_of([(" ".join(draw.choices(names, k=1000)), lang) for lang in ("a", "b") for _ in range(150)])
    tracemalloc.start()
    try:
        pairs = kneser_ney.Pairs(row)
        dealt = sum(len(part) for _, _, part in pairs.dealt(9))
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert dealt == len(pairs.different) > 250_000
    assert most < 48 * len(pairs.words)


def test_words_of_one_hash_are_one_word(monkeypatch):
    draw, real = random.Random(9), kneser_ney.xxhash.xxh32_intdigest
    monkeypatch.setattr(kneser_ney.xxhash, "xxh32_intdigest", lambda *of: real(*of) % 97)
    texts = [(" ".join(f"w{draw.randrange(400)}" for _ in range(50)), lang) for lang in ("a", None, "a") for _ in range(5)]
    row = block_of([*texts, ("", "b")])
    hashes, langs, words = (kneser_ney.unpack(row[k], "<u4") for k in ("vocabulary", "word_langs", "words"))
    assert len(set(zip(langs.tolist(), hashes.tolist()))) == len(hashes) == row["distinct"] <= 3 * 97
    seeds = {"a": real(b"a", 1) % 97, None: 0}
    assert hashes[words].tolist() == [real(w.encode(), seeds[lang]) % 97 for text, lang in texts for w in text.split()]
    assert [row["langs"][k] for k in langs[words]] == [lang for text, lang in texts for _ in text.split()]


def test_rows_go_to_python_a_few_megabytes_at_once(spark):
    """A row can be a whole block, and a batch of Arrow had up to 10,000 rows."""
    def sizes(batches):
        for batch in batches:
            yield kneser_ney._rows("n long", [(batch.num_rows,)])

    name = next(iter(kneser_ney.BATCH))
    before = spark.conf.get(name, None)
    docs = spark.range(0, 12, 1, 1).selectExpr("repeat('a', 1 << 21) AS text")
    with workspace.setting(spark, kneser_ney.BATCH):
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 12 and max(found) <= 3
    assert spark.conf.get(name, None) == before


def test_all_steps_bound_what_goes_to_python(spark, monkeypatch):
    seen, write = [], kneser_ney.materialize
    name = next(iter(kneser_ney.BATCH))
    monkeypatch.setattr(kneser_ney, "materialize", lambda *a, **b: seen.append(spark.conf.get(name)) or write(*a, **b))
    before = spark.conf.get(name, None)
    docs = spark.createDataFrame([(1, "some few words", "en")], "doc_id long, text string, lang string")
    kneser_ney.perplexity(docs)
    assert seen == [kneser_ney.BATCH[name]] * 3 and spark.conf.get(name, None) == before
