"""License scans: ordered signature rules over words, gated by keywords, resolved by priority and containment.

One Aho-Corasick pass finds the keywords of a text; only rules all of whose keywords occur are tried, each on
the whole text. A detection goes if one of a rule that ranks as high or higher contains its interval: so a
title inside a grant, or a short name inside a title, says nothing more. Base phrases are counted before that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import schema_of, slices, with_columns, without
from .license_rules import BASE, KINDS, Rule, rules

ADDED = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,kind:string,first:bigint,words:bigint>>"
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
#: Letters A-Z in lower case; other ASCII characters than letters and digits become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Detection(NamedTuple):
    """first, end: words from first up to end; rule: its place in the order."""

    first: int
    end: int
    rule: int
    label: str


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def resolve(found: list[Detection], priority: list[int]) -> list[Detection]:
    """Those that no other detection of as high a priority contains; of equal intervals the earliest rule stays.
    One sweep by beginning keeps, for each priority, how far detections so far reach."""
    reach = [-1] * len(KINDS)
    kept = []
    for d in sorted(set(found), key=lambda d: (d.first, -d.end, priority[d.rule], d.rule, d.label)):
        level = priority[d.rule]
        if max(reach[: level + 1]) < d.end:
            kept.append(d)
        reach[level] = max(reach[level], d.end)
    return kept


class Scanner:
    """The rules with their automaton and patterns; compiled once a worker."""

    def __init__(self, base: tuple[tuple[str, str], ...] = tuple(BASE)):
        self.rules: list[Rule] = rules(list(base))
        self.priority = [r.priority for r in self.rules]
        self._patterns = [r.compiled() for r in self.rules]
        keys = sorted({k for r in self.rules for k in r.keywords})
        self._of: dict[str, list[int]] = {k: [] for k in keys}
        for i, r in enumerate(self.rules):
            for k in set(r.keywords):
                self._of[k].append(i)
        self._needed = [len(set(r.keywords)) for r in self.rules]
        self._automaton = ahocorasick.Automaton()
        for k in keys:
            self._automaton.add_word(f" {k}", k)
        self._automaton.make_automaton()

    def gated(self, words: str) -> list[int]:
        """Rules all of whose keywords begin at a word of `` w1 w2 ``."""
        left: dict[int, int] = {}
        for k in {k for _, k in self._automaton.iter(words)}:
            for i in self._of[k]:
                left[i] = left.get(i, 0) + 1
        return sorted(i for i, n in left.items() if n == self._needed[i])

    def matches(self, words: list[bytes]) -> list[Detection]:
        """All matches of the gated rules, before any is suppressed."""
        padded = " " + b" ".join(words).decode() + " "
        gated = self.gated(padded)
        if not gated:
            return []
        text = padded[1:-1]
        spans = []
        for i in gated:
            for m in self._patterns[i].finditer(text):
                end = m.end() if self.rules[i].kind != "base" else m.start() + len(re.sub(r"\\(.)", r"\1", self.rules[i].pattern))
                spans.append((m.start(), end, i, m.expand(self.rules[i].label).strip("-").replace(" ", ".").replace("--", "-")))
        found, at, word = [], 0, 0
        for start, end, i, label in sorted(spans):
            word, at = word + text.count(" ", at, start), start
            found.append(Detection(word, word + text.count(" ", start, end) + 1, i, label))
        return found

    def scan(self, text: str | None) -> tuple[int, list[Detection], list[Detection]]:
        """Number of words, places of base phrases, and detections that stay."""
        words = words_of(text)
        found = self.matches(words)
        return len(words), [d for d in found if self.rules[d.rule].kind == "base"], resolve(found, self.priority)


@cache
def _scanner(base: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(base)


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = tuple(BASE), keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    base: phrases (lower-case words) and labels that are counted at all their places. labels: those of base
    places and of the detections that stay, distinct, sorted, joined by commas; empty where there are none.
    score: one less the product of what each kind of rule found leaves in doubt, each rule once. A null text
    counts as an empty one; repeated rows are treated alike; an empty table stays empty; input columns of these
    names are replaced. A text of any length is scanned whole.
    """
    source = without(docs, *[c.split(" ")[0] for c in ADDED.split(", ")])
    gone = [] if keep_text else ["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(base)
        sure = list(KINDS.values())
        for batch in (x for b in batches for x in slices(b, "text")):
            out: dict[str, list] = {c.split(" ")[0]: [] for c in ADDED.split(", ")}
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                n, places, kept = scanner.scan(text)
                labels = {d.label for d in places}
                doubt = 1.0
                for i in sorted({d.rule for d in kept}):
                    doubt *= 1 - sure[scanner.priority[i]]
                row = [n, len(places), min((d.first for d in places), default=None), max((d.first for d in places), default=None)]
                row += [",".join(sorted(labels)), ",".join(sorted(labels | {d.label for d in kept})), 1 - doubt]
                row.append([{"label": d.label, "kind": scanner.rules[d.rule].kind, "first": d.first, "words": d.end - d.first} for d in kept])
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _FOUND]
            yield with_columns(batch, gone, **{name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})

    kept = source.drop(*gone)
    return source.mapInArrow(run, schema_of(kept, ADDED))
