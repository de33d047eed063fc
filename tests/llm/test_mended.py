"""Secrets against names and random strings, decontamination both ways, clashing columns in the mix, one encoding."""

import random
import string
import time

from pyspark.sql import functions as F

from framelake.llm import decontamination, mixing, secrets, token_counts
from framelake.llm.common import table
from framelake.llm.queries import QUERIES

WORDS = ("repository transaction coordinator factory manager handler service config user account payment index cache stream buffer "
         "reader writer connection database session request response parser builder token secret value list queue node tree graph "
         "image frame batch table column schema Verfassung Gesellschaft informacion desarrollo").split()


def made_name(rng):
    parts = [rng.choice(WORDS) for _ in range(rng.randint(3, 5))]
    return rng.choice([
        lambda: "".join(p.title() for p in parts), lambda: parts[0] + "".join(p.title() for p in parts[1:]),
        lambda: "_".join(parts) + str(rng.randrange(100)), lambda: "/" + "/".join(parts) + f"/MyProject{rng.randrange(3000)}",
        lambda: "Donau" + "".join(parts) + "gesellschaft", lambda: ".".join(parts) + "V2", lambda: "-".join(parts).upper() + "7"])()


def test_names_are_no_secrets():
    rng, scanner, flagged = random.Random(1), secrets.NoveltyScanner(), 0
    for k in range(1000):
        name = made_name(rng)
        text = f"the token for {name} is set" if k % 2 else f"see {name} as api key"
        flagged += any(kind == "novel" for *_, kind in scanner.scan(text))
    assert flagged <= 20
    for name in ("RepositoryTransactionCoordinator", "Donaudampfschifffahrtsgesellschaft",
                 "/projects/MyProject2024/locations/europeWest1/keyRings/main"):
        assert scanner.novel(f"secret {name} token", []) == []


def test_random_strings_are_found_on_either_side():
    rng, scanner, found = random.Random(2), secrets.NoveltyScanner(), 0
    for k in range(1000):
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(16, 64)))
        text, at = (f"the token that works is {value} here", 24) if k % 2 else (f"put {value} as slack token", 4)
        found += (at, at + len(value), "novel") in scanner.scan(text)
    assert found >= 950


def plain_novel(scanner, text):
    """Candidates near a sensitive word, one by one, where no base span lies and none follows another."""
    out = set()
    for m in secrets.CANDIDATE.finditer(text):
        near = any(0 <= m.start() - w.end() <= scanner.reach or 0 <= w.start() - m.end() <= scanner.reach
                   for w in secrets.SENSITIVE.finditer(text))
        if near and scanner.is_novel(text, *m.span()):
            out.add((*m.span(), "novel"))
    return out


def test_novel_spans_equal_a_plain_search():
    rng, scanner, some = random.Random(3), secrets.NoveltyScanner(), 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(3, 12)):
            parts.append(rng.choice([
                lambda: rng.choice(["token", "bearer", "passphrase", "secret"]), lambda: made_name(rng), lambda: "plain words of text " * 4,
                lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(16, 30))) + " " + "pad " * 13])())
        text = " ".join(parts)
        expected = plain_novel(scanner, text)
        found = set(scanner.novel(text, scanner.base(text)))
        some += bool(expected)
        assert found == expected, text
    assert some > 50


def test_scanning_is_linear():
    scanner, begin = secrets.NoveltyScanner(), time.process_time()
    scanner.scan("token " * 50_000)
    scanner.scan("a1B2" * 50_000 + " token " * 1000)
    assert time.process_time() - begin < 10


# Decontamination --------------------------------------------------------------------------------

def test_short_items_are_no_passages(spark):
    docs = spark.createDataFrame([(1, "the"), (2, "all of the words"), (3, "One  two THREE"), (4, "so one two three it is")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "the"), (11, "one two three"), (12, "one two three"), (13, "a b c d e f g h")], "item_id long, text string")
    found = decontamination.contaminated(docs, items)
    assert {(r.doc_id, r.item_id, r.coverage) for r in found.collect()} == {(1, 10, 1.0), (3, 11, 1.0), (3, 12, 1.0)}
    flags = decontamination.is_contaminated(docs, items).filter("contaminated")
    assert {r.doc_id for r in flags.collect()} == {1, 3}


def test_a_shared_preamble_costs_little():
    preamble = "answer the following question in one short sentence please".encode().split()
    items = [(str(k), preamble + [b"item%d" % (k * 20 + j) for j in range(20)]) for k in range(100_000)]
    index = decontamination.SeedIndex(items, 8)
    doc = preamble + [b"w%d" % j for j in range(500)] + items[77][1][9:]
    begin = time.process_time()
    assert index.candidates(doc, 0.5) == [77]
    assert time.process_time() - begin < 0.5  # about a twentieth where it was measured


def test_found_pairs_equal_plain_tiling(spark, sf):
    """Both ways: every document and item of the small tables, tiled without seeds or candidates."""
    docs = {r.doc_id: (r.text or "").lower().encode().split() for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: (r.text or "").lower().encode().split() for r in table(spark, sf, "benchmark").collect()}
    runs = {d: {tuple(t[i:i + 8]) for i in range(len(t) - 7)} for d, t in docs.items()}
    expected = set()
    for k, words in items.items():
        own = {tuple(words[i:i + 8]) for i in range(len(words) - 7)}
        for d, tokens in docs.items():
            if own & runs[d]:
                covered = sum(n for _, _, n in decontamination.tile(tokens, words, 8))
                if covered >= 0.5 * len(words):
                    expected.add((d, k, covered))
    found = {(r.doc_id, r.item_id, r.covered) for r in QUERIES["op10_benchmark_decontamination"](spark, sf).collect()}
    assert found == expected and found


# Mix and token counts ---------------------------------------------------------------------------

def test_mix_keeps_columns_of_any_name(spark):
    inner = ["__source", "__rate", "__docs", "__size", "__name", "__group", "__blocks", "__block", "__chance", "__open", "__row", "__of", "__words"]
    df = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("x "), (F.col("id") % 40).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), *[F.concat(F.lit(n), "id").alias(n) for n in inner])
    mixed, plain = mixing.mix_documents(df, block=16), mixing.mix_documents(df.drop(*inner), block=16)
    assert mixed.columns == [*df.columns, "size", "source_size", "target", "copies", "taken"]
    rows = {r.doc_id: r for r in mixed.collect()}
    assert all(rows[i][n] == f"{n}{i}" for i in rows for n in inner)
    assert {i: r.taken for i, r in rows.items()} == {r.doc_id: r.taken for r in plain.collect()}


def test_texts_are_encoded_once(spark, sf):
    sums = QUERIES["op5_token_counts"](spark, sf)
    assert "MapInArrow" not in sums._jdf.queryExecution().executedPlan().toString()
    lengths = {r.n_tokens: r.n_docs for r in sums.collect()}
    for limit in (0, 100, 333, 10**6):
        cut = sum(min(n, limit) * d for n, d in lengths.items())
        assert token_counts.truncated_total(sums, limit).first()[0] == cut
    assert token_counts.truncated_total(sums.limit(0), 5).first()[0] == 0
