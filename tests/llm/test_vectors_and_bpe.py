"""Centroid clustering, vector codes and byte-level BPE against plain versions, and on odd input."""

import base64
import hashlib
import math
import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from framelake.llm import byte_bpe, code_compression, va_clusters, vectors
from framelake.llm.common import table
from framelake.llm.queries import ORACLES, QUERIES
from tests.compare import connect, oracle_rows, spark_rows


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_code_compression"])
def test_equals_sql(spark, name, size):
    where = f"/root/testdata/{size}"
    assert spark_rows(QUERIES[name](spark, where)) == oracle_rows(connect(where), ORACLES[name])


def floors(values, scale):
    return [math.floor(scale * float(np.float32(x))) for x in values]


def usable(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_clusters(rows, k=16, rounds=3):
    """(vec_id, cluster, distance) by comparing everything, in whole numbers of Python."""
    points = [(i, floors(v, 64)) for i, v, *_ in usable(rows)]
    seeds = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in points)[:k]
    centroids = [v for *_, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in points:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in points]


def plain_codes(rows, entries=64, rounds=2):
    """(vec_id, code, error) by comparing everything."""
    points = [(i, floors(v, 256)) for i, v, *_ in usable(rows)]
    ordered = sorted(points, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    out = [[i, "", 0] for i, _ in points]
    for p in range(16):
        book = [tuple(v[4 * p:4 * p + 4]) for _, v in ordered]
        parts = [tuple(v[4 * p:4 * p + 4]) for _, v in points]
        nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(book))
        for _ in range(rounds):
            members = {}
            for v in parts:
                members.setdefault(nearest(v)[1], []).append(v)
            book = [tuple(sum(x) // len(x) for x in zip(*members[n])) if n in members else c for n, c in enumerate(book)]
        for row, v in zip(out, parts):
            d, n = nearest(v)
            row[1] += f"{n:02x}"
            row[2] += d
    return [tuple(r) for r in out]


SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, code string, components string, distance string"


def odd_vectors():
    """Nulls anywhere, wrong sizes, non-finite values, repeated rows and ids, ties, clashing columns."""
    rng = random.Random(11)
    flat = [0.0] * 64
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 3) for i in range(90)]
    rows += [(200, flat, None), (200, flat, None), (201, flat, 1), (202, [0.25] * 64, None), (None, [-0.5] * 64, 7), (None, flat, 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * 63, 1), (303, [1.0] * 65, 1), (304, [None] + [1.0] * 63, 1),
             (305, [float("nan")] + [1.0] * 63, 1), (306, [float("inf")] * 64, 1), (307, [-float("inf")] + [0.0] * 63, 1)]
    rows += [(400, [rng.choice([-1e-3, 0.0, 1e-3]) for _ in range(64)], 2) for _ in range(30)]
    return [(*r, "a", "b", "c", "d") for r in rows]


def test_clusters_of_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = sorted(plain_clusters(rows), key=str)
    for bits in (1, 3, 6, 8):
        found = va_clusters.cluster(df, bits=bits)
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == expected
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert {r.inertia for r in found.collect()} == {sum(d for *_, d in expected)}


def test_codes_of_odd_rows(spark):
    rows = odd_vectors()
    found = code_compression.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in found), key=str) == sorted(plain_codes(rows), key=str)
    labels, by_label = {r[0]: r[2] for r in rows if r[0] is not None}, {}
    for r in found:
        by_label.setdefault(r.label_error, []).append(r)
    null = [r for r in found if r.vec_id in (200, 202)]
    assert len(null) == 3 and {r.label_error for r in null} == {sum(r.error for r in null)}
    assert {labels[r.vec_id] for r in null} == {None}


def test_few_rows_none_and_huge_components(spark):
    two = [(2, [0.5] * 64, 1, *"abcd"), (1, [-0.5] * 64, None, *"abcd")]
    df = spark.createDataFrame(two, SCHEMA)
    assert sorted(r.distance for r in va_clusters.cluster(df).collect()) == [0, 0]
    assert sorted((r.vec_id, r.code, r.error) for r in code_compression.compress(df).collect()) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    for empty in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, None, *"abcd")], SCHEMA)):
        assert va_clusters.cluster(empty).collect() == [] == code_compression.compress(empty).collect()
    # Components beyond 2**27 count as that; the distance of the two extremes still fits a long.
    far = spark.createDataFrame([(i, [sign * 3e38] * 64, 1, *"abcd") for i, sign in enumerate((1, -1, 1))], SCHEMA)
    assert [r.distance for r in va_clusters.cluster(far, k=1, rounds=0).select("distance").collect()].count(64 << 56) in (1, 2)
    assert {r.error for r in code_compression.compress(far).collect()} == {0}


def test_cells_bound_distances():
    rng = np.random.default_rng(5)
    points = rng.integers(-40, 40, (300, 64)).astype(np.int32)
    for bits in (1, 2, 6, 8):
        cells = va_clusters.Cells(points.min(0).astype(np.int64), points.max(0).astype(np.int64), points.mean(0), points.std(0), bits)
        packed = cells.pack(points)
        assert packed.shape == (300, 8 * bits)
        numbers = cells.unpack(packed)
        d = np.arange(64)
        assert (cells.least[d, numbers] <= points).all() and (points <= cells.largest[d, numbers]).all()
        assert numbers.max() < 1 << bits
    one = va_clusters.Cells(*(np.full(64, x) for x in (7, 7, 7.0, 0.0)), 4)
    assert one.least[0, one.unpack(one.pack(np.full((1, 64), 7, np.int32)))[0, 0]] == 7


def test_few_vectors_are_needed(spark, sf):
    """Most rows are decided by their cells; more bits leave fewer open."""
    df, open_rows = table(spark, sf, "embeddings"), []
    for bits in (4, 6):
        file, cells = va_clusters.approximate(df, "vec_id", "embedding", 64, 64, bits)
        open_rows.append(va_clusters.move(file, cells, va_clusters.first_centroids(file, 16))[1])
    assert open_rows[1] < 0.2 * 500 < open_rows[0]


def test_bounds_stay_true():
    rng = np.random.default_rng(9)
    points, entries = rng.integers(-60, 60, (400, 4)), rng.integers(-60, 60, (64, 4))
    bounds, work = code_compression.searched(points, entries, 16), []
    for step in (9, 4, 2, 1, 0):
        after = entries + rng.integers(-step, step + 1, entries.shape)
        moves = np.sqrt(((after - entries) ** 2).sum(1).astype(float))
        bounds, need, measured = code_compression.reassigned(points, after, code_compression.moved(bounds, moves))
        bounds, entries = bounds.cut(max(8, min(bounds.width, need))), after
        squares = code_compression.squared(points, entries)
        assert (bounds.near[:, 0] == squares.argmin(1)).all()  # argmin: ties to the lower entry
        exact = np.sqrt(np.take_along_axis(squares, bounds.near.astype(int), 1))
        assert (bounds.lows <= exact).all() and (np.diff(bounds.lows, axis=1) >= 0).all()
        others = np.sqrt(squares.astype(float))
        np.put_along_axis(others, bounds.near.astype(int), np.inf, 1)
        assert (bounds.outer <= others.min(1)).all()
        work.append((bounds.width, measured))
    assert work[-1][0] < 16 and work[-1][1] < 0.2 * 400 * 64


def test_bounds_outlive_a_round(spark, sf):
    """The state carries b closest entries a part, b shrinks, and later rounds measure less than the first."""
    state, books = code_compression.train(table(spark, sf, "embeddings"))
    rows = state.select(F.length("near").alias("n"), F.length("lows").alias("l"), F.length("outer").alias("o"), "measured").collect()
    assert {r.n for r in rows} <= {16 * b for b in range(8, 17)} and all(r.l == 4 * r.n and r.o == 64 for r in rows)
    assert books.shape == (16, 64, 4) and sum(r.measured for r in rows) < 0.6 * len(rows) * 16 * 64


def test_group_sums_are_exact():
    groups, rows = np.array([2, 0, 2, 2]), np.array([[1 << 27, -1], [5, 6], [1 << 27, 7], [-3, 8]], np.int32)
    counts, sums = vectors.group_sums(groups, rows, 4)
    assert counts.tolist() == [1, 0, 3, 0] and sums.tolist() == [[5, 6], [0, 0], [(1 << 28) - 3, 14], [0, 0]]


# Byte-level BPE ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(byte_bpe.read_vocabulary(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_of_all_documents(spark, sf, other):
    rows = {r.doc_id: r for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    assert set(rows) == set(texts)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    for doc_id, text in texts.items():
        ids = other.encode_ordinary(text)
        assert tuple(rows[doc_id]) == (
            doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest(text.encode()))


def test_bpe_of_random_texts(own, other):
    rng = random.Random(13)
    alphabets = ["ab", "aeinrst ", "abcdefghijklmnopqrstuvwxyz'", "éàüñ漢字🙂 a", "01 .,\n\t\x1c\x85 　", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))
        assert own.encode(text) == other.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_very_long_pre_tokens(own, other):
    rng = random.Random(14)
    for text in ("a" * 50_000, "".join(rng.choice("eantis") for _ in range(50_000)), " " * 30_000 + "x", "漢" * 10_000, "!" * 40_000):
        assert own.encode(text) == other.encode_ordinary(text)
    assert not any(own.queue.buckets) and not any(own.queue.words)


def plain_merge(ranks, piece):
    """Merge the pair of the lowest rank, the leftmost of equal ones, until there is none."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        at = min(pairs)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


def test_merges_by_a_plain_search(own):
    rng = random.Random(15)
    assert len(own.queue.words) == 197 and len(own.queue.buckets) == 50_256
    for _ in range(3000):
        piece = bytes(rng.choice(rng.choice([b"aeinst", b"ab", b"0123456789", bytes(range(256))])) for _ in range(rng.randrange(1, 40)))
        if piece not in own.ranks:
            assert own.merge(piece) == plain_merge(own.ranks, piece)


def test_generations_change_nothing(own, monkeypatch):
    texts = [" ".join(f"w{i % 50} x{i}" for i in range(200)) for _ in range(3)]
    expected = [own.encode(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "CACHED", 16)
    small = byte_bpe.Codec(byte_bpe.read_vocabulary(), public_tokenizers.PATTERN)
    assert [small.encode(t) for t in texts] == expected and len(small.recent) <= 16 and len(small.before) <= 16


def test_remembered_pre_tokens_cost_no_step(own):
    text = " ".join(f"w{i % 50}" for i in range(5000))
    expected, calls = own.encode(text), []
    sys.setprofile(lambda *event: calls.append(event))
    try:
        found = own.encode(text)
    finally:
        sys.setprofile(None)
    assert found == expected and len(calls) < 50


def test_texts_of_a_batch(other, monkeypatch):
    """Ids and bytes of whole batches are those of single texts, also where a generation ends within a text."""
    monkeypatch.setattr(byte_bpe, "CACHED", 16)
    small = byte_bpe.Codec(byte_bpe.read_vocabulary(), public_tokenizers.PATTERN)
    texts = ["", None, "a lone word", "\x00 漢字🙂 e\u0301", "x" * 200, *(f"v{i} {i * i}" for i in range(300)), None]
    column = pa.array(["cut off", *texts])[1:]
    coded = small.encode_all(column)
    assert coded.to_pylist() == [other.encode_ordinary(text or "") for text in texts]
    assert small.decode_all(coded).to_pylist() == [(text or "").encode() for text in texts]
    assert small.decode_all(small.encode_all(column[:0])).to_pylist() == []
    assert small.decode_all(small.encode_all(pa.array([None, ""], pa.string()))).to_pylist() == [b"", b""]


def test_lower_ranks_go_before_equal_ones():
    """A merge may make a pair of a lower rank than the bucket it came from."""
    tokens = [b"abc", b"ab", b"abcabc"]
    ranks = {t: i for i, t in enumerate(tokens)} | {bytes([i]): 10 + i for i in range(256)}
    lines = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    small = byte_bpe.Codec(lines, r"\S+|\s+")
    theirs = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(16)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        assert small.encode(text) == theirs.encode_ordinary(text)


def test_bpe_of_odd_rows(spark, odd_docs, no_docs):
    coded = byte_bpe.decode(byte_bpe.encode(odd_docs))
    assert coded.columns == [*odd_docs.columns, "ids", "decoded"]
    for r in coded.collect():
        assert bytes(r.decoded).decode() == (r.text or "") and (r.ids == []) == (not r.text)
    assert byte_bpe.digest(odd_docs).count() == odd_docs.count()
    assert byte_bpe.digest(no_docs).collect() == [] and byte_bpe.encode(no_docs).collect() == []
    named = byte_bpe.encode(odd_docs.withColumnRenamed("lang", "ids"))
    assert named.columns == ["doc_id", "text", "ids", "source", "n_chars", "size", "copies", "kept"]
    ids = spark.createDataFrame([([1, None],), ([99_999],), (None,), ([],), ([72],)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(ids.coalesce(1)).collect()] == [None, None, b"", b"", byte_bpe.codec(
        byte_bpe.read_vocabulary(), "").tokens[72]]


def test_round_trip_keeps_columns(spark, odd_docs):
    named = odd_docs.withColumnRenamed("lang", "ids").withColumnRenamed("size", "_text")
    coded = byte_bpe.round_trip(named)
    assert coded.columns == ["doc_id", "text", "source", "n_chars", "_text", "copies", "kept", "ids", "decoded"]
    apart = byte_bpe.decode(byte_bpe.encode(odd_docs)).select("doc_id", "ids", "decoded").collect()
    assert sorted(map(str, coded.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, apart))


def test_each_text_is_encoded_once(spark, sf):
    plan = QUERIES["op13_byte_bpe"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
