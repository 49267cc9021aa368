"""Licence scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

A text's words (see WORD) are lower-cased and joined by one space. Base phrases are counted at every place
and always kept. The rules of license_rules are tried where their keyword stands in the text; every hit is
an interval of words with a priority (text of a licence, stated notice, bare name). A hit goes if another
one of higher priority, or of equal priority and longer or earlier in the rules, contains its interval.

Cases: a null or empty text has no words, no places and empty labels. Repeated rows are scanned each. Very
long texts are scanned whole; memory is that of one batch of texts and one text's words. An empty table
gives an empty result. Only doc_id and text are read.
"""

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship, text_bytes

#: Words are runs of these: digits, letters after lower-casing, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEXT, NOTICED, NAMED = 3, 2, 1
#: Confidence of a hit by priority; base phrases alone count as a bare name.
CONFIDENCE = {TEXT: 0.99, NOTICED: 0.9, NAMED: 0.6}

RESULT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, n_hits bigint, n_suppressed bigint"
)


def _whole_words(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern that are not inside a group."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def keyword(pattern: str) -> str:
    """The longest literal that every whole-word match of a pattern without alternatives holds, spaces around included."""
    pattern, runs, depth, at = f" {pattern} ", [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c in "([":
            depth += 1
        if not depth:
            if c in "?*{":
                runs[-1] = runs[-1][:-1]
            if c.isalnum() or c == " ":
                runs[-1] += c
            else:
                runs.append("")
            if c == "{":
                at = pattern.index("}", at)
        elif c in ")]":
            depth -= 1
        else:
            runs.append("")
        at += 1
    return max(runs, key=len)


@cache
def rules() -> list[tuple[bytes, int, str, re.Pattern[bytes]]]:
    """Keyword, priority, label and regex, in order. An empty label means the regex names it."""
    from bidmatrix.llm import license_rules as given

    texts = [(TEXT, label, part, part) for label, pattern in given.TEXTS for part in branches(pattern)]
    tags = [(NOTICED, "", given.SPDX, given.SPDX)]
    names = [
        (NAMED, label, part, f"(?P<notice>{given.NOTICE})?(?:{part})")
        for label, *patterns in given.NAMES for pattern in patterns for part in branches(pattern)
    ]
    return [
        (keyword(part).encode(), priority, label, _whole_words(pattern))
        for priority, label, part, pattern in texts + tags + names
    ]


@cache
def gate() -> ahocorasick.Automaton:
    """Finds the rules' keywords in one pass over a text."""
    automaton = ahocorasick.Automaton()
    for word in {rule[0] for rule in rules()}:
        automaton.add_word(word.decode("latin-1"), word)
    automaton.make_automaton()
    return automaton


@cache
def _base() -> list[tuple[bytes, str, re.Pattern[bytes]]]:
    return [(phrase.encode(), label, _whole_words(phrase)) for phrase, label in BASE]


def hits(norm: bytes) -> list[tuple[int, int, int, str]]:
    """Start and end position, priority and label of every rule's hits, in the order of the rules."""
    present = {word for _, word in gate().iter(f" {norm.decode('latin-1')} ")}
    found = []
    for word, priority, label, pattern in rules() if present else ():
        if word not in present:
            continue
        for m in pattern.finditer(norm):
            groups = m.groupdict()
            strength = NOTICED if groups.get("notice") else priority
            name = label or groups["tag"].decode().replace(" ", "-")
            start = m.end("notice") if groups.get("notice") else m.start()
            found.append((start, m.end(), strength, name))
    return found


def resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The hits that no stronger one contains: by priority, then length, then order of the rules.

    One sweep per priority: a hit is contained if one that starts no later ends no earlier, among those of
    higher priority or before it in its own. That what contains it may itself be contained changes nothing.
    """
    if not found:
        return []
    start, end, priority = (np.array([h[k] for h in found]) for k in range(3))
    kept = np.zeros(len(found), bool)
    stronger_start, stronger_end = np.zeros(0, int), np.zeros(0, int)  # by start; the furthest end so far
    for level in -np.unique(-priority):
        own = np.flatnonzero(priority == level)
        own = own[np.lexsort((own, -end[own], start[own]))]
        before = np.concatenate([[-1], np.maximum.accumulate(end[own])[:-1]])
        above = np.append(-1, stronger_end)[np.searchsorted(stronger_start, start[own], side="right")]
        kept[own] = np.maximum(before, above) < end[own]
        starts = np.concatenate([stronger_start, start[own]])
        order = np.argsort(starts, kind="stable")
        stronger_start = starts[order]
        stronger_end = np.maximum.accumulate(np.concatenate([stronger_end, end[own]])[order])
    ranked = np.lexsort((np.arange(len(found)), start - end, -priority))
    return [found[k] for k in ranked[kept[ranked]]]


def scan_text(text: bytes) -> tuple:
    """n_words ... n_suppressed of one text."""
    words = text.translate(_BYTES).split()
    norm = b" ".join(words)
    places, labels, blanks = [], set(), None
    for phrase, label, pattern in _base():
        if phrase in norm:
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            starts = np.searchsorted(blanks, [m.start() for m in pattern.finditer(norm)]).tolist()
            places += starts
            labels |= {label} if starts else set()
    found = hits(norm)
    kept = resolve(found)
    strongest = max([CONFIDENCE[k[2]] for k in kept] + [CONFIDENCE[NAMED]] * bool(places), default=0.0)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {k[3] for k in kept})), strongest, len(kept), len(found) - len(kept),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: see RESULT."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_hits", "n_suppressed"]
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            view = memoryview(data)
            rows = [scan_text(bytes(view[a:b])) for a, b in zip(starts[:-1], starts[1:])]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, RESULT)
