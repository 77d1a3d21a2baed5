"""License scans by ordered signature rules.

A text is put in normal form once; an automaton finds the keywords it has, only rules with all of their keywords are
tried, and detections that lie inside another one of no lower priority are suppressed.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import license_rules
from .license_rules import CONFIDENCE, Rule
from .support import map_documents, raw_texts

#: Phrases whose places are counted, and their labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Bytes of words, A-Z lower-cased; all others become spaces.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

Span = tuple[int, int, int, str]  # start, end, priority, label


def normal_form(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_NORMAL).split())


def suppress(found: list[Span]) -> list[Span]:
    """Detections that no other one contains: of two, one goes if the other holds its whole interval with no lower
    priority; between equal intervals and priorities the first by label stays.

    Outer intervals come first in (start, -end) order, so what contains a span is among those kept before it; the ones
    that end before it starts are dropped from view.
    """
    kept: list[Span] = []
    open_spans: list[Span] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        start, end, priority, _ = span
        open_spans = [o for o in open_spans if o[1] > start]
        if not any(o[1] >= end and o[2] >= priority for o in open_spans):
            kept.append(span)
        open_spans.append(span)
    # a later, longer-or-equal one of higher priority can only share the start, which the order puts first
    return kept


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = license_rules.build() if rules is None else rules
        self.always = [i for i, r in enumerate(self.rules) if not r.keywords]
        self.patterns = [re.compile(r.pattern) for r in self.rules]
        self.needed = [len(set(r.keywords)) for r in self.rules]
        owners: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in set(rule.keywords):
                owners.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, own in owners.items():
            self.automaton.add_word(word, (word, own))
        if owners:
            self.automaton.make_automaton()
        self.owners = owners

    def detect(self, text: str) -> list[Span]:
        """Surviving detections in a text in normal form."""
        hits = Counter(self.always)
        if self.owners:
            for word in {word for _, (word, _) in self.automaton.iter(text)}:
                hits.update(self.owners[word])
        found = []
        for i in sorted(i for i, n in hits.items() if n >= self.needed[i]):
            rule = self.rules[i]
            found += [(m.start(), m.end(), rule.priority, rule.label) for m in self.patterns[i].finditer(text) if m.end() > m.start()]
        return suppress(found)

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int, int]]]:
        normal = normal_form(text)
        words = normal.count(b" ") + 1 if normal else 0
        framed = b" " + normal + b" "
        found, base = [], set()
        if b"license" in framed:
            for phrase, label in BASE.items():
                at = framed.find(b" " + phrase + b" ")
                while at >= 0:
                    found.append(at)
                    base.add(label)
                    at = framed.find(b" " + phrase + b" ", at + 1)
        places = _words_before(np.frombuffer(framed, np.uint8), found)
        plain = normal.decode()
        spans = self.detect(plain)
        labels = base | {s[3] for s in spans}
        score = max([CONFIDENCE.get(s[2], 0.5) for s in spans] + [0.5] * bool(base), default=0.0)
        letters = np.frombuffer(plain.encode("utf-32-le"), "<u4") if spans else np.empty(0, np.uint32)
        first, last = (_words_before(letters, [s[side] for s in spans]) for side in (0, 1))
        in_words = [(s[3], s[2], a, b) for s, a, b in zip(spans, first, last)]
        return (
            words, len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, in_words,
        )


def _words_before(letters: np.ndarray, places: list[int]) -> list[int]:
    """How many spaces stand before each place."""
    return np.searchsorted(np.flatnonzero(letters == 32), np.array(places, np.int64)).tolist() if places else []


_scanner: list[Scanner] = []

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,priority:int,first_word:int,last_word:int>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: word and base phrase counts, labels, score and the surviving spans in words.

    Words are runs of digits, a-z and non-ASCII after A-Z are lower-cased. ``n_base`` counts every place of a base
    phrase; ``labels`` joins base labels with those of surviving detections; the score is the confidence of the best
    detection, 0 without any. A null or empty text has no words and no labels. Ids may be null or repeated; an empty
    table gives no row; extra columns are ignored. Whole texts are scanned, in one pass without a shuffle.
    """

    def make():
        if not _scanner:
            _scanner.append(Scanner())
        scanner = _scanner[0]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*[scanner.scan(t) for t in raw_texts(batch.column(1))]))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            spans = [[dict(zip(("label", "priority", "first_word", "last_word"), s)) for s in row] for row in columns[7]]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays, pa.array(spans, _SPANS)], names)

        return apply

    return map_documents(docs, [id_col, text_col], SCHEMA, make)
