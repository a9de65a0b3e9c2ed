"""Licence texts in documents by patience alignment.

A template and a text are aligned as a reader would: words that occur once in both are anchors, the longest
increasing run of anchors is kept, and the gaps between them are aligned in the same way; a gap
without anchors takes equal words from both ends and then, as gaps are no longer than a template, its longest
common subsequence. Coverage is the share of the template's words that are aligned. Long texts are first
narrowed down to the stretches in which the template's words stand close enough together.

The templates are files in ``license_texts``, taken from the published licences and not from any table: whole bodies
(``... text``: MIT, BSD, ISC, zlib, Boost, Unlicense, Apache, GPL, LGPL, AGPL, MPL, CC0), standard headers (``... header``) and
one-line notices in several wordings, of which a document gives one row. A licence's words are often nearly another's,
so a wording names runs of words that must stand in the stretch (its name, version or own clause). The two-clause BSD body is
a part of the three-clause one, which gives rows for both. SPDX lines give ``spdx:`` and the identifier in lower case.

Defined results: NULL and empty texts and templates without words give no match; a template that occurs
several times gives one row with the best stretch and the number of stretches; repeated rows and NULL ids
each give their own rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

TEXTS = Path(__file__).parent / "license_texts"
# Spellings that mean the same in licence texts.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense"}
COVERAGE = 0.8
WORD = re.compile(r"\w+")
SPDX = re.compile(
    r"(?i:spdx-license-identifier):[ \t]*(\(*[A-Za-z0-9][\w.+:-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][\w.+:-]*\)*)*)"
)
MATCH = "template string, coverage double, start int, stop int, stretches int"


def words_of(text: str) -> list[str]:
    """Words in lower case and one spelling."""
    return [SPELLINGS.get(w, w) for w in WORD.findall(text.lower())]


def read_wordings() -> list[tuple[str, list[str], str]]:
    """``name, must, text`` of all notices, headers and bodies in ``license_texts``."""
    found = []
    for line in (TEXTS / "notices.tsv").read_text("utf-8").splitlines():
        name, must, text = line.split("\t")
        found.append((name, must.split("|"), text))
    for path in sorted(TEXTS.glob("*.txt")):
        head, _, text = path.read_text("utf-8").partition("---\n")
        found.append((path.stem, [x.removeprefix("must: ") for x in head.splitlines()], text))
    return found


WORDINGS = read_wordings()
# The first wording of each notice.
TEMPLATES = {name: text for name, _, text in reversed(WORDINGS) if not name.endswith((" text", " header"))}


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing run, by patience piles with links back."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a column of the table in the bits of one number."""
    where: dict[str, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        both = row & where.get(x, 0)
        row = (row + both | row - both) & full
    return len(b) - row.bit_count()


def aligned(a: list[str], b: list[str]) -> int:
    """Number of words of ``b`` that the patience alignment with ``a`` matches."""
    total = 0
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0, total = a0 + 1, b0 + 1, total + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, total = a1 - 1, b1 - 1, total + 1
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = [(i, where[a[i]]) for i in range(a0, a1) if a[i] in where]
        if not anchors:
            total += _common(a[a0:a1], b[b0:b1])
            continue
        for k in longest_increasing([j for _, j in anchors]):
            i, j = anchors[k]
            waiting.append((a0, i, b0, j))
            a0, b0, total = i + 1, j + 1, total + 1
        waiting.append((a0, a1, b0, b1))
    return total


def stretches(words: list[str], template: list[str], coverage: float) -> Iterator[tuple[int, int]]:
    """Stretches of a text that hold enough of the template's words, closer than the template is long."""
    wanted = Counter(template)
    hits = [i for i, w in enumerate(words) if w in wanted]
    least = coverage * len(template)
    start = 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k] - hits[k - 1] > len(template):
            inside = words[hits[start] : hits[k - 1] + 1]
            if sum(min(n, wanted[w]) for w, n in Counter(inside).items() if w in wanted) >= least:
                yield hits[start], hits[k - 1] + 1
            start = k


def windows(start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """A stretch as overlapping windows of at most three template lengths; two share two lengths."""
    while stop - start > 3 * size:
        yield start, start + 3 * size
        start += size
    yield start, stop


def holds(words: list[str], must: list[list[str]]) -> bool:
    """Each run of ``must`` stands in the words."""
    return all(any(words[i : i + len(run)] == run for i, w in enumerate(words) if w == run[0]) for run in must)


def best_match(
    words: list[str], template: list[str], coverage: float, must: list[list[str]] = ()
) -> tuple[float, int, int, int] | None:
    """Best coverage, its words from and to, and how many stretches reach ``coverage``."""
    best, count = None, 0
    for whole in stretches(words, template, coverage):
        top = None
        for start, stop in windows(*whole, len(template)):
            if not holds(words[start:stop], must):
                continue
            share = aligned(words[start:stop], template) / len(template)
            if share >= coverage and (top is None or share > top[0]):
                top = (share, start, stop)
        if top:
            count += 1
            if best is None or top[0] > best[0]:
                best = top
    return (*best, count) if best else None


def identifiers(body: str) -> Iterator[tuple[str, float, int, int, int]]:
    """A row for each licence that SPDX lines of a text name; exceptions after WITH are no licences."""
    found: dict[str, list] = {}
    for line in SPDX.finditer(body):
        start = len(WORD.findall(body[: line.start()]))
        stop = start + len(WORD.findall(line[0]))
        parts = re.findall(r"[^\s()]+", line[1])
        own = [p for i, p in enumerate(parts) if p not in ("AND", "OR", "WITH") and (i == 0 or parts[i - 1] != "WITH")]
        for name in {f"spdx:{p.rstrip('.:-').lower()}" for p in own}:
            row = found.setdefault(name, [start, stop, 0])
            row[2] += 1
    for name in sorted(found):
        yield name, 1.0, *found[name]


class Finder:
    """Matches of all wordings in one text; a name takes its best wording."""

    def __init__(self, wordings: list[tuple[str, list[str], str]], coverage: float):
        known = [(name, words_of(text), [words_of(m) for m in must]) for name, must, text in wordings]
        self.known = [(name, words, must) for name, words, must in known if words]
        self.coverage = coverage
        self.place = {w: i for i, w in enumerate(sorted({w for _, words, _ in self.known for w in words}))}
        self.counts = np.zeros((len(self.known), len(self.place)), np.int32)
        for row, (_, words, _) in zip(self.counts, self.known, strict=True):
            for w, n in Counter(words).items():
                row[self.place[w]] = n
        self.least = coverage * self.counts.sum(axis=1) - 1e-9

    def find(self, body: str) -> Iterator[tuple[str, float, int, int, int]]:
        words = words_of(body)
        own = [(self.place[w], n) for w, n in Counter(words).items() if w in self.place]
        if not own:
            return
        at, n = np.array(own).T
        # No alignment matches more than the words that both hold.
        possible = np.flatnonzero(np.minimum(self.counts[:, at], n).sum(axis=1) >= self.least)
        best: dict[str, tuple[float, int, int, int]] = {}
        for i in possible:
            name, template, must = self.known[i]
            match = best_match(words, template, self.coverage, must)
            if match and (name not in best or match[0] > best[name][0]):
                best[name] = match
        for name, match in best.items():
            yield name, *match


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for every document and template with at least ``coverage`` of its words; no shuffle.

    Without ``templates`` these are all of ``WORDINGS``, and licences named by SPDX lines.
    """
    finder = Finder([(name, [], t) for name, t in templates.items()] if templates else WORDINGS, coverage)
    named = not templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch["key"], batch["text"], strict=True):
                own = None if pd.isna(k) else int(k)
                rows += [(own, *match) for match in finder.find(body)]
                if named and "spdx" in body.lower():
                    rows += [(own, *match) for match in identifiers(body)]
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in MATCH.split(", ")]]).astype({key: "Int64"})

    flat = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return flat.mapInPandas(run, f"{key} bigint, {MATCH}")
