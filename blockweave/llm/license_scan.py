"""License mentions by ordered signature rules.

A document's words are normalised once; only rules whose keyword is among them are tried.  A detection inside the span of
one of a better priority, or of a longer one of the same, is suppressed.  Phrases that are counted at all their places, the base,
are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches
from .license_rules import RULES

#: Label, priority, phrase: every place counts.
BASE = [("cc-by", 2, "cc by"), ("gpl", 2, "general public license"), ("reserved", 3, "all rights reserved")]
#: How likely a detection of this priority is right.
TRUST = {1: 0.95, 2: 0.8, 3: 0.5}
#: A-Z lower-cased; digits, letters and bytes beyond ASCII stay, all others are blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
DETECTION = "struct<label:string,rule:int,priority:int,first_word:bigint,last_word:bigint>"
SCAN = f"struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,detections:array<{DETECTION}>>"


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    base: bool


class Detection(NamedTuple):
    label: str
    rule: int
    priority: int
    first_word: int
    last_word: int


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")


def load_rules(text: str = RULES) -> list[Rule]:
    """The base phrases, then the rules of ``text`` in its order; a phrase's keyword is its longest word."""
    rules = [Rule(label, priority, max(phrase.split(), key=len).encode(), _compiled(phrase), True) for label, priority, phrase in BASE]
    for line in text.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        rules.append(Rule(label, int(priority), keyword.encode(), _compiled(pattern), False))
    return rules


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that lie in no other's span of better priority, nor in a longer one's (or an earlier rule's) of the same."""
    found = sorted(found, key=lambda d: (d.first_word, -d.last_word, d.priority, d.rule))
    reach: dict[int, int] = {}  # for each priority the last word of the detections that start here or before
    kept = []
    for d in found:
        if all(to < d.last_word for p, to in reach.items() if p <= d.priority):
            kept.append(d)
        reach[d.priority] = max(reach.get(d.priority, -1), d.last_word)
    return kept


def scan_text(rules: list[Rule], by_keyword: dict[bytes, list[int]], text: bytes) -> tuple[int, list[Detection], list[Detection]]:
    """Number of words, all detections of base phrases, and the other rules' that are not suppressed."""
    words = text.translate(FOLD).split(b" ")
    present = set(words)
    tried = sorted(i for k in present & by_keyword.keys() for i in by_keyword[k])
    n_words = len(words) - words.count(b"")
    if not tried:
        return n_words, [], []
    plain = b" " + b" ".join(w for w in words if w) + b" "
    blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    found: list[Detection] = []
    for i in tried:
        spans = [m.span() for m in rules[i].pattern.finditer(plain)]
        if spans:
            first = np.searchsorted(blanks, [a for a, _ in spans]) - 1
            last = np.searchsorted(blanks, [b for _, b in spans]) - 1
            found += [Detection(rules[i].label, i, rules[i].priority, a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return n_words, [d for d in found if rules[d.rule].base], [d for d in suppress(found) if not rules[d.rule].base]


def license_scan(text: Column | str, docs: DataFrame) -> Column:
    """A struct for each whole text: n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  n_base counts all places of the base
    phrases, first_word and last_word are their smallest and largest start (words from 0; null without any).  base_labels are
    the labels of these phrases, labels those and the labels of all detections that are not suppressed, both distinct, sorted and joined by commas
    (empty without any).  score is the chance that one of the labels is right: one minus the product, over labels, of the doubt in the
    label's best detection; 0 without any.  ``detections`` holds label, rule number, priority and first and last word of each, by place.

    Null texts are empty: no words, no labels, score 0.  Repeated rows get the same result, an empty table gives no rows.  ``docs`` is
    the frame the column is for; the session's Arrow batches are limited to about 8 MB.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = load_rules()
        by_keyword: dict[bytes, list[int]] = {}
        for i, r in enumerate(rules):
            by_keyword.setdefault(r.keyword, []).append(i)
        fields = [name for name, _ in KIND]
        for texts in batches:
            out = []
            for item in texts:
                n_words, base, other = scan_text(rules, by_keyword, item.as_py() or b"")
                both = sorted(base + other, key=lambda d: (d.first_word, d.last_word, d.rule))
                trust: dict[str, float] = {}
                for d in both:
                    trust[d.label] = max(trust.get(d.label, 0.0), TRUST[d.priority])
                doubt = 1.0
                for label in sorted(trust):
                    doubt *= 1 - trust[label]
                starts = [d.first_word for d in base]
                out.append((n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d.label for d in base})), ",".join(sorted(trust)), 1 - doubt, [d._asdict() for d in both]))
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, KIND, strict=True)], fields)

    return F.arrow_udf(run, SCAN, F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


_DETECTIONS = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
KIND = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", _DETECTIONS)]
