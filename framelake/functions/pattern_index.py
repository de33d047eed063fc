"""Classification by thousands of ordered name patterns.

A chain of thousands of conditions tries each pattern on each name. Here the literal parts of the patterns
stand in a trie; one pass over a name proposes the rules whose literal it holds, and those without one, and
the regular expressions of the proposed rules decide, in the order of the rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

from framelake.functions.naming import UNKNOWN, base_name

_END = ""


def literals(pattern: str) -> list[str]:
    """Texts that every match of a regular expression holds, as far as plain reading tells.

    Groups, classes and anything optional count as no text. Alternatives outside groups, flags that change the
    meaning of letters and quoted spans give none.
    """
    if "(?" in pattern or "\\Q" in pattern:
        return []
    runs, run, at, depth = [], "", 0, 0
    while at < len(pattern):
        c, size, literal = pattern[at], 1, None
        if c == "\\" and at + 1 < len(pattern):
            size = 2
            literal = None if pattern[at + 1].isalnum() else pattern[at + 1]
        elif c == "[":
            size = _class_end(pattern, at) - at
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return []
        elif c not in "|.^$*+?{}]":
            literal = c
        at += size
        if depth or literal is None:
            runs, run = [*runs, run], ""
            if c == "{":  # an escaped brace is read above; this one ends a repetition
                at = max(at, pattern.find("}", at) + 1)
            continue
        follows = pattern[at:at + 1]
        if follows and follows in "*?{":
            runs, run = [*runs, run], ""
        else:
            run += literal
            if follows == "+":
                runs, run = [*runs, run], ""
    return sorted({text for text in [*runs, run] if text})


def _class_end(pattern: str, at: int) -> int:
    """Where a character class that begins at ``at`` ends; classes may hold classes."""
    depth, place = 0, at
    while place < len(pattern):
        c = pattern[place]
        if c == "\\":
            place += 1
        elif c == "[":
            depth += 1
        elif c == "]" and place > at + 1:
            depth -= 1
            if not depth:
                return place + 1
        place += 1
    return len(pattern)


def _trie(rules: Sequence[tuple[str, str]]) -> tuple[dict, list[int]]:
    """(trie of literals, at whose ends stand the numbers of rules; rules that are always tried).

    Of its literals a rule stands under the one that fewest rules have, the longest of those.
    """
    root, always = {}, []
    texts = [literals(pattern) for _, pattern in rules]
    shared = Counter(text for own in texts for text in own)
    for number, own in enumerate(texts):
        if not own:
            always.append(number)
            continue
        node = root
        for c in min(own, key=lambda text: (shared[text], -len(text))):
            node = node.setdefault(c, {})
        node.setdefault(_END, []).append(number)
    return root, always


def _proposed(name: str, root: dict, always: list[int]) -> list[int]:
    found = set(always)
    for start in range(len(name)):
        node = root
        for c in name[start:]:
            node = node.get(c)
            if node is None:
                break
            if _END in node:
                found.update(node[_END])
    return sorted(found)


def classify_by_index(path: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """``naming.classify_by_patterns`` for any number of (type, regular expression) pairs."""
    root, always = _trie(rules)
    name = base_name(path)

    @F.arrow_udf("array<int>")
    def proposed(names: pa.Array) -> pa.Array:
        return pa.array([None if n is None else _proposed(n, root, always) for n in names.to_pylist()], pa.list_(pa.int32()))

    kinds = F.array(*[F.lit(kind) for kind, _ in rules]) if rules else F.array().cast("array<string>")
    patterns = F.array(*[F.lit(pattern) for _, pattern in rules]) if rules else F.array().cast("array<string>")
    # Rules rise in a proposal, so the first that matches is the first in order.
    first = F.aggregate(
        proposed(name), F.lit(-1),
        lambda chosen, rule: F.when((chosen < 0) & F.regexp_like(name, F.get(patterns, rule)), rule).otherwise(chosen))
    return F.coalesce(F.get(kinds, F.when(first >= 0, first)), F.lit(UNKNOWN))
