"""Secret scans by dictionary-primed compression.

Three fixed patterns give the base spans. Further candidates are long runs of key characters
shortly before or after a sensitive word, or after a candidate that was reported; of a run that a base span
touches, the parts outside it. A candidate whose letters, digits and capitals come in runs as long as those of
words is a name or path and is left alone. Each is compressed by zstandard with a raw dictionary made of
common identifiers and the text around it: an identifier, a path or a word that the surroundings
already hold costs few bytes, a random string costs about its length. Candidates whose marginal
bytes reach ``novelty`` of their length are reported as ``novel``.

Nulls: a null text is scanned as an empty one. Repeated rows are scanned each for itself; ties
cannot occur. Texts are scanned whole. An empty table gives an empty result; other columns of the
input are passed on unread, whatever their names, unless they bear an output name, in which case
the output replaces them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

import pyarrow as pa

# The three base kinds and their patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(
    r"passw(?:or)?d|passwd|passphrase|secret|token|api[_ -]?key|credential|bearer|"
    r"(?:private|access|signing|encryption|auth)[_ -]?key|authorization",
    re.IGNORECASE | re.ASCII,
)
#: One of these, lower-cased, is in every text that ``SENSITIVE`` or ``ASSIGN`` can match.
STEMS = ("passw", "passphrase", "secret", "token", "api", "credential", "bearer", "key", "authorization")
KEY_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=~-")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]+")

IDENTIFIERS = (
    "configuration connection string authentication authorization application environment variable "
    "password username secret_key access_key api_key client_id client_secret refresh_token access_token "
    "session_token private_key public_key certificate localhost database postgres mysql mongodb redis "
    "https://www.example.com http://localhost:8080 /usr/local/bin /etc/config /home/user "
    "public static final String void return function const export import require module default "
    "getElementById addEventListener toString hashCode equals length undefined null true false None True "
    "os.environ.get process.env settings.SECRET config.get_password changeme placeholder example_token "
    "your_api_key_here insert_password_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef"
).encode()


#: Letters that begin with a capital at most, capitals, or digits.
RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: What may be a word or a name's part: four letters or more with a vowel and no five consonants on end.
WORD = re.compile(r"(?=[a-z]*[aeiouy])(?![a-z]*[^aeiouy]{5})[a-z]{4,}", re.IGNORECASE)
#: Share of letters in words that makes a name; share of neighbours of a random string that belong to different
#: runs, and how many standard deviations below it still count as random.
NAMED, BREAKS, BELOW = 0.6, 0.45, 2.5


def is_broken(value: str) -> bool:
    """Whether runs of like characters are as short as chance makes them, and few are words."""
    runs = RUN.findall(value)
    size = sum(map(len, runs))
    if sum(len(run) for run in runs if WORD.fullmatch(run)) > NAMED * size:
        return False
    return len(runs) >= 1 + BREAKS * (size - 1) - BELOW * (BREAKS * (1 - BREAKS) * max(size - 1, 0)) ** 0.5


def outside(taken: list[tuple[int, int]], first: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a span that the sorted spans from ``first`` on leave."""
    while start < end and first < len(taken) and taken[first][0] < end:
        if taken[first][0] > start:
            yield start, taken[first][0]
        start, first = max(start, taken[first][1]), first + 1
    if start < end:
        yield start, end


class NoveltyScanner:
    """Spans of one text. ``context`` and ``reach`` are in characters.

    A candidate starts at most ``reach`` characters after the end of a sensitive word or a novel candidate.
    """

    def __init__(self, minimum: int = 16, reach: int = 48, context: int = 1024, novelty: float = 0.85):
        self.minimum, self.reach, self.context, self.novelty = minimum, reach, context, novelty

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """Base spans as (start, end, kind), unsorted."""
        lower = text.lower()
        found = []
        if any(stem in lower for stem in ("passw", "secret", "token", "api")):
            found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if "AKIA" in text:
            found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
        return found

    def marginal_bytes(self, candidate: str, surroundings: str) -> int:
        """Bytes that ``candidate`` adds to a frame primed with its surroundings and identifiers."""
        near = surroundings.replace(candidate, " ")
        prime = zstandard.ZstdCompressionDict(
            IDENTIFIERS + near.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        compressor = zstandard.ZstdCompressor(
            level=12, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        return len(compressor.compress(candidate.encode())) - len(compressor.compress(b""))

    def novel(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Incompressible candidates in a sensitive context, without the parts that base spans take.

        A novel candidate carries its context on from its end, so a secret of many lines is followed to
        its close, with the shorter last line of a wrapped one.
        """
        lower = text.lower()
        if not any(stem in lower for stem in STEMS):
            return []
        taken = sorted((s, e) for s, e, _ in base)
        found, done, t, before, since = [], 0, 0, [], 0
        for word in SENSITIVE.finditer(text):
            ahead, since = self.ahead(text, word.start(), taken, since)
            before += ahead
            at, limit = max(word.end(), done), word.end() + self.reach
            while m := CANDIDATE.search(text, at):
                if m.start() > limit:
                    break
                at = done = m.end()
                while t < len(taken) and taken[t][1] <= m.start():
                    t += 1
                for start, end in outside(taken, t, *m.span()):
                    if self.is_novel(text, start, end) or self.ends_lines(text, start, end, found):
                        found.append((start, end, "novel"))
                        limit = end + self.reach
        return sorted({*found, *before})

    def ahead(self, text: str, word: int, taken: list[tuple[int, int]], since: int) -> tuple[list[tuple[int, int, str]], int]:
        """(novel candidates that end at most ``reach`` characters before a sensitive word, how far they were looked for).

        What lies before ``since`` was looked at for an earlier word.
        """
        at = max(since, word - self.reach)
        while at > since and text[at - 1] in KEY_CHARACTERS:  # from the start of a candidate that reaches in
            at -= 1
        found = []
        for m in CANDIDATE.finditer(text, at, word):
            since = m.end()
            for start, end in outside(taken, max(0, bisect_left(taken, (m.start(), 0)) - 1), *m.span()):
                if self.is_novel(text, start, end):
                    found.append((start, end, "novel"))
        return found, since

    @staticmethod
    def ends_lines(text: str, start: int, end: int, found: list[tuple[int, int, str]]) -> bool:
        """Whether a line is the rest of the two novel lines of one length right before it."""
        if len(found) < 2 or text[start] == "-":
            return False
        (a, b, _), (c, d, _) = found[-2:]
        between, after = (text[b:c], text[d:start]), text[end:end + 1]
        return b - a == d - c > end - start and all("\n" in x and not x.strip() for x in between) and after in ("", "\n", "\r")

    def is_novel(self, text: str, start: int, end: int) -> bool:
        value = text[start:end].strip(".=-/")
        kinds = sum(any(test(c) for c in value) for test in (str.isdigit, str.islower, str.isupper))
        if len(value) < self.minimum or kinds < 2 or not is_broken(value):
            return False
        around = text[max(0, start - self.context):start] + " " + text[end:end + self.context]
        return self.marginal_bytes(value, around) >= self.novelty * len(value)

    def scan(self, text: str | None) -> list[tuple[int, int, str]]:
        """All spans by start, then kind as listed in ``KINDS``, then end."""
        if not text:
            return []
        base = self.base(text)
        return sorted(base + self.novel(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
]))


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", **settings) -> DataFrame:
    """``docs`` with a column of (kind, start, end); positions are code points, end exclusive."""
    scanner = NoveltyScanner(**settings)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[{"kind": k, "start": s, "end": e} for s, e, k in scanner.scan(t.as_py())] for t in texts], kind
        )

    return docs.withColumn(spans, scan(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", **settings) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans are merged.

    A text without secrets, null included, stays as it is.
    """
    scanner = NoveltyScanner(**settings)

    @F.arrow_udf(StringType())
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            value = value.as_py()
            parts, done = [], 0
            for start, end, _ in scanner.scan(value):
                if start >= done:
                    parts += [value[done:start], mark]
                done = max(done, end)
            out.append("".join(parts) + value[done:] if parts else value)
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns per row of ``docs`` with ``doc_id`` and ``text``."""
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    label = F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind != "novel")
    joined = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined, 256).alias("base_sha256"),
        F.array_join(label, ",").alias("spans"),
    )
