"""Transcript parsing by a hidden Markov model, before canonical rendering of turns.

A transcript is a sequence of lines. Its hidden states are, for each of the roles, "a turn of this
role begins here" and "it goes on". Emissions are the speaker marker of a line (``User:``,
``### Assistant``, ``<|system|>``, ``Q:`` ... or none) and the line's form (blank, question, code or
list, short, long). The most probable state sequence, by Viterbi, gives roles and turn borders even
where markers are missing, wrong or inside a text.

Viterbi is a chain of products in the (max, +) algebra, so transcripts are cut into pieces of
``PIECE`` rows that are summed up independently, each as a matrix from entry to exit state; a scan
over the matrices, in levels of ``FAN`` where there are more, fixes the states at the borders; then
each piece is decoded on its own. The result is that of one run over the whole transcript, and no
task gathers more than a piece or ``FAN`` matrices, however long one transcript is.

Nulls: a null text is a blank line; a null id is a transcript of its own; a null position comes last
and a null label is no marker. Repeated rows and ties in position are ordered by label and text. An
empty table gives an empty result. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framelake.llm.common import schema_of
from framelake.workspace import materialize

ROLES = ("system", "user", "assistant")
#: Rows of a piece, and pieces whose matrices one task scans.
PIECE, FAN = 256, 4096

# Speaker markers by role, in lower case.
MARKERS = {
    "system": "system sys instruction instructions context".split(),
    "user": "user human customer client prompter question q me student interviewer".split(),
    "assistant": "assistant bot ai gpt agent model answer a response tutor chatbot".split(),
}
_ROLE = {name: k for k, role in enumerate(ROLES) for name in MARKERS[role]}
_NAMES = "|".join(sorted(_ROLE, key=len, reverse=True))
MARKER = re.compile(
    rf"^[ \t]*(?:<\|(?:im_start\|>)?(?P<a>{_NAMES})(?:\|>)?|#{{1,6}}[ \t]*(?P<b>{_NAMES})[ \t]*:?(?=\s|$)|"
    rf"\[(?P<c>{_NAMES})\]:?|\*\*(?P<d>{_NAMES}):?\*\*:?|(?P<e>{_NAMES})[ \t]*[:>])[ \t]*",
    re.IGNORECASE,
)
END = re.compile(r"[ \t]*(?:<\|im_end\|>|<\|end\|>|</s>)[ \t]*$")

# States: 2 * role + (0 begins, 1 goes on).
STATES = 2 * len(ROLES)
FORMS = ("blank", "question", "code", "short", "long")


def _model() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities: first state, transitions, markers and forms by state."""
    next_role = np.array([[0.02, 0.88, 0.10], [0.011, 0.027, 0.962], [0.012, 0.957, 0.031]])
    goes_on = np.array([0.45, 0.55, 0.70])
    first = np.zeros(STATES)
    first[0::2] = (0.2, 0.75, 0.05)
    move = np.zeros((STATES, STATES))
    for s in range(STATES):
        role = s // 2
        move[s, 2 * role + 1] = goes_on[role]
        move[s, 0::2] = (1 - goes_on[role]) * next_role[role]
    # Markers: one per role, the last column for none. A turn begins with its own marker as a rule;
    # a line that goes on has a marker only if the text happens to look like one.
    mark = np.full((STATES, len(ROLES) + 1), 0.004)
    for role in range(len(ROLES)):
        mark[2 * role, role], mark[2 * role, -1] = 0.892, 0.1
        mark[2 * role + 1, -1] = 0.988
    form = np.array([  # blank, question, code, short, long
        [0.02, 0.03, 0.05, 0.30, 0.60], [0.15, 0.02, 0.08, 0.30, 0.45],
        [0.02, 0.25, 0.03, 0.45, 0.25], [0.15, 0.20, 0.10, 0.30, 0.25],
        [0.02, 0.06, 0.07, 0.30, 0.55], [0.15, 0.05, 0.20, 0.20, 0.40]])
    with np.errstate(divide="ignore"):
        return np.log(first), np.log(move), np.log(mark), np.log(form)


FIRST, MOVE, MARK, FORM = _model()
CODE = re.compile(r"^\s*(?:```|[-*+] |\d+[.)] |[{}<>|]|def |class |import |return |    )")


def observe(line: str) -> tuple[int, int, str]:
    """Marker (``len(ROLES)`` for none) and form of a line, and the line without its marker."""
    found = MARKER.match(line)
    rest = END.sub("", line[found.end():] if found else line)
    marker = _ROLE[next(g for g in found.groups() if g).lower()] if found else len(ROLES)
    bare = rest.strip()
    if not bare:
        form = 0
    elif bare.endswith("?"):
        form = 1
    elif CODE.match(rest):
        form = 2
    else:
        form = 3 if len(bare) < 120 else 4
    return marker, form, rest


def summary(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of a piece from each state before it to each at its end, and from a transcript's start."""
    through, opening = None, None
    for step in scores:
        through = MOVE + step if through is None else (through[:, :, None] + MOVE).max(1) + step
        opening = FIRST + step if opening is None else (opening[:, None] + MOVE).max(0) + step
    return through, opening


def decode(scores: np.ndarray, entry: int = -1, leave: int = -1) -> np.ndarray:
    """The best states between the state before (-1: the transcript starts) and the last one (-1: any)."""
    back = np.zeros((len(scores), STATES), np.int8)
    best = (FIRST if entry < 0 else MOVE[entry]) + scores[0]
    for t in range(1, len(scores)):
        ways = best[:, None] + MOVE
        back[t] = ways.argmax(0)
        best = ways.max(0) + scores[t]
    states = np.zeros(len(scores), np.int64)
    state = int(best.argmax()) if leave < 0 else leave
    for t in range(len(scores) - 1, -1, -1):
        states[t], state = state, back[t, state]
    return states


def borders_of(through: np.ndarray, opening: np.ndarray, entry: int, leave: int) -> tuple[list[int], list[int]]:
    """Entry and exit states of consecutive pieces, given those of the whole stretch."""
    best = [opening[0] if entry < 0 else through[0][entry]]
    for matrix in through[1:]:
        best.append((best[-1][:, None] + matrix).max(0))
    exits = [int(best[-1].argmax()) if leave < 0 else leave]
    for k in range(len(through) - 1, 0, -1):
        exits.append(int((best[k - 1] + through[k][:, exits[-1]]).argmax()))
    exits.reverse()
    return [entry, *exits[:-1]], exits


def lines_of(label: str | None, text: str | None) -> list[str]:
    """Lines of a row; its speaker label, if any, stands before its text as a marker."""
    return ((f"{label}: " if label else "") + (text or "")).split("\n")


def emissions(lines: list[str], places: list[tuple]) -> tuple[np.ndarray, list[str]]:
    """Log-probabilities (lines, STATES), and the lines without markers.

    A line's place, its row's position and its number in the row, shifts them by a millionth at
    most. That decides between paths of equal probability alike however a transcript is cut.
    """
    seen = [observe(line) for line in lines]
    marker, form = np.array([s[0] for s in seen]), np.array([s[1] for s in seen])
    # A marker line without more text says nothing by being blank.
    silent = (form == 0) & (marker < len(ROLES))
    shift = np.frombuffer(b"".join(xxhash.xxh64_digest(repr(p)) for p in places), np.uint8).reshape(len(lines), 8)[:, :STATES]
    return MARK[:, marker].T + np.where(silent[:, None], 0, FORM[:, form].T) + shift * 4e-9, [s[2] for s in seen]


def scores_of(rows: list[dict]) -> tuple[np.ndarray, list[str], list[int]]:
    """Emissions and bare lines of rows with position, label and text, and each row's number of lines."""
    lines = [lines_of(r["label"], r["text"]) for r in rows]
    places = [(r["position"], k) for r, own in zip(rows, lines) for k in range(len(own))]
    return *emissions([x for own in lines for x in own], places), [len(own) for own in lines]


def parts_of(states: np.ndarray, lines: list[str]) -> list[tuple[int, bool, str]]:
    """Turns, or parts of turns, of consecutive lines: role, whether it begins here, text."""
    out: list[tuple[int, bool, list[str]]] = []
    for state, line in zip(states.tolist(), lines):
        if state % 2 == 0 or not out:
            out.append((state // 2, state % 2 == 0, [line]))
        else:
            out[-1][2].append(line)
    return [(role, begins, "\n".join(own)) for role, begins, own in out]


def render(role: str, begins: bool, text: str) -> str:
    """Canonical form: a role line opens each turn, and every part ends with a line end."""
    return (f"<|{role}|>\n" if begins else "") + text + "\n"


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if held and rows[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                last, start = rows[start], i
    if held:
        yield pa.Table.from_batches(held)


def _rows_of(fields: str, columns: list) -> pa.RecordBatch:
    schema = schema_of(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _numbered(rows: DataFrame, piece: int) -> DataFrame:
    """Rows with the number of their piece; numbers grow along a transcript.

    Rows are sorted over all partitions by range, so a long transcript spans many; a piece is a
    stretch of ``piece`` rows within a partition.
    """
    fields = "conversation long, position long, label string, text string, place long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            place = (batch.column(4).to_numpy(zero_copy_only=False) << 32) + np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(place)], schema=schema_of(fields))

    order = [F.asc_nulls_last("conversation"), F.asc_nulls_last("position"), "label", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(number, fields)
    return materialize(placed.withColumn("piece", F.floor(F.col("place") / piece).cast("long")), "transcript-lines")


MATRICES = "conversation long, piece long, through array<double>, opening array<double>"
BORDERS = "conversation long, piece long, entry int, leave int"


def _dealt(df: DataFrame, *keys: str, then: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("conversation", "piece")):
        through, opening = summary(scores_of(table.select(["position", "label", "text"]).to_pylist())[0])
        yield _rows_of(MATRICES, [table["conversation"].to_pylist()[:1], table["piece"].to_pylist()[:1],
                                  [through.ravel().tolist()], [opening.tolist()]])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("conversation", "parent")):
        through, opening = None, None
        for a, b in zip(table["through"].to_pylist(), table["opening"].to_pylist()):
            matrix = np.array(a).reshape(STATES, STATES)
            opening = np.array(b) if opening is None else (opening[:, None] + matrix).max(0)
            through = matrix if through is None else (through[:, :, None] + matrix).max(1)
        yield _rows_of(MATRICES, [table["conversation"].to_pylist()[:1], table["parent"].to_pylist()[:1],
                                  [through.ravel().tolist()], [opening.tolist()]])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("conversation", "parent")):
        through = [np.array(x).reshape(STATES, STATES) for x in table["through"].to_pylist()]
        opening = [np.array(x) for x in table["opening"].to_pylist()[:1]]
        entries, exits = borders_of(through, opening, table["entry"][0].as_py(), table["leave"][0].as_py())
        yield _rows_of(BORDERS, [table["conversation"].to_pylist(), table["piece"].to_pylist(), entries, exits])


def _borders(pieces: DataFrame, fan: int) -> DataFrame:
    """States before and at the end of every piece, on a best path of its whole transcript."""
    most = pieces.groupBy("conversation").count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        open_ended = pieces.withColumns({"parent": F.lit(0).cast("long"), "entry": F.lit(-1), "leave": F.lit(-1)})
        return _dealt(open_ended, "conversation", "parent", then=("piece",)).mapInArrow(_spread, BORDERS)
    grouped = pieces.withColumn("parent", F.floor(F.col("piece") / fan).cast("long"))
    above = materialize(_dealt(grouped, "conversation", "parent", then=("piece",)).mapInArrow(_products, MATRICES), "hmm-pieces")
    known = materialize(_borders(above, fan), "hmm-borders").select(
        F.col("conversation").alias("c"), F.col("piece").alias("p"), "entry", "leave")
    joined = grouped.join(known, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")))
    return _dealt(joined.drop("c", "p"), "conversation", "parent", then=("piece",)).mapInArrow(_spread, BORDERS)


PARTS = ("conversation long, position long, place long, part int, role string, begins boolean, text string, "
         "rendered string")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ("conversation", "piece")):
        rows = table.to_pylist()
        scores, bare, sizes = scores_of(rows)
        states = decode(scores, rows[0]["entry"], rows[0]["leave"])
        out, at = [], 0
        for row, n in zip(rows, sizes):
            found = parts_of(states[at:at + n], bare[at:at + n])
            at += n
            out += [(row["conversation"], row["position"], row["place"], k, ROLES[role], begins, text,
                     render(ROLES[role], begins, text)) for k, (role, begins, text) in enumerate(found)]
        yield _rows_of(PARTS, list(zip(*out)))


def parse(rows: DataFrame, conversation: str = "conv_id", position: str = "turn", speaker: str | None = "role",
          text: str = "text", piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """Turns of transcripts, as parts of their rows.

    ``rows`` are the stretches of a transcript in order, such as turns as they were logged; a row's
    speaker label counts as a marker, and its text may hold the markers of further turns. Each row
    gives one output row per turn, or part of one, in it: ``part`` numbers them, ``begins`` tells
    whether the turn starts there, ``place`` grows along a transcript. The ``rendered`` strings of a
    transcript, joined in order of place and part, are its canonical form.
    """
    label = F.col(speaker).cast("string") if speaker else F.lit(None).cast("string")
    base = _numbered(rows.select(
        F.col(conversation).cast("long").alias("conversation"), F.col(position).cast("long").alias("position"),
        label.alias("label"), F.col(text).alias("text")), piece)
    pieces = materialize(_dealt(base, "conversation", "piece", then=("place",)).mapInArrow(_summaries, MATRICES), "hmm-pieces")
    known = materialize(_borders(pieces, fan), "hmm-borders").select(
        F.col("conversation").alias("c"), F.col("piece").alias("p"), "entry", "leave")
    joined = base.join(known, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).drop("c", "p")
    return _dealt(joined, "conversation", "piece", then=("place",)).mapInArrow(_decode, PARTS) \
        .withColumnsRenamed({"conversation": conversation, "position": position})
