"""License phrases: exact phrases by their words, and short notices with a few edits.

Exact part: places where a phrase's words stand one after another, found from the bytes of
its rarest word and confirmed against the word spans.

Fuzzy part: a notice that may have e edits is cut into e+1 pieces; by the pigeonhole
principle one of them stands unchanged in any match.  Pieces are found by exact byte search,
and the ``regex`` library's bounded-error matching confirms the text around each hit and
gives the edits and the span.  A match may differ in at most the notice's own bound, and not
in the name that decides the label.  Short forms and the base phrases are notices with small
bounds; their matches inside one of a longer notice of the label are that notice's.

Defined cases: null and empty texts have 0 words and no labels; overlapping places of a
phrase all count; a label found in several ways is listed once; texts of any length are
searched whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ALNUM_WORDS, LOWER, chunks, spans

#: Phrases of the base labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # lower case
    edits: int
    name: str = ""  # the part that decides the label and bears no edit


#: Short notices of public licences, and the edits that a match may have.
NOTICES = (
    Notice("apache", "licensed under the apache license, version 2.0", 4, "apache"),
    Notice("mit", "released under the mit license", 3, "mit"),
    Notice("mit", "permission is hereby granted, free of charge, to any person obtaining a copy", 7),
    Notice("gpl", "under the terms of the gnu general public license", 4, "gnu"),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "subject to the terms of the mozilla public license", 4, "mozilla"),
    Notice("cc", "licensed under a creative commons attribution", 4, "creative commons"),
    Notice("gpl", "licensed under the gnu general public license", 4, "gnu"),
    Notice("cc", "licensed under cc by", 2, "cc by"),
    Notice("cc", "licensed under cc-by", 2, "cc-by"),
    Notice("gpl", "gnu general public license", 2, "gnu"),
    Notice("gpl", "general public license", 1, "general public"),
    Notice("apache", "apache license", 1, "apache"),
    Notice("mit", "mit license", 1, "mit"),
    Notice("lgpl", "gnu lesser general public license", 3, "gnu lesser"),
    Notice("agpl", "gnu affero general public license", 3, "gnu affero"),
    Notice("mpl", "mozilla public license", 2, "mozilla"),
    Notice("epl", "eclipse public license", 2, "eclipse"),
    Notice("boost", "boost software license", 2, "boost"),
    Notice("bsd", "bsd 2-clause license", 1, "bsd 2-clause"),
    Notice("bsd", "bsd 3-clause license", 1, "bsd 3-clause"),
    Notice("isc", "permission to use, copy, modify, and/or distribute this software for any purpose", 6),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
    Notice("mit", "spdx-license-identifier: mit", 2, "mit"),
    Notice("apache", "spdx-license-identifier: apache-2.0", 2, "apache-2.0"),
    Notice("bsd", "spdx-license-identifier: bsd-3-clause", 2, "bsd-3-clause"),
    Notice("mpl", "spdx-license-identifier: mpl-2.0", 2, "mpl-2.0"),
    Notice("gpl", "spdx-license-identifier: gpl-3.0-only", 2, "gpl-3.0"),
    Notice("cc", "spdx-license-identifier: cc-by-4.0", 2, "cc-by"),
)


def pattern_of(notice: Notice) -> regex.Pattern:
    """The notice with edits around its name; each side may have all of them, so their sum is still to be checked."""
    side = lambda t: f"(?:{regex.escape(t, special_only=True)}){{e<={notice.edits}}}" if t else ""
    if not notice.name:
        return regex.compile(f"(?b){side(notice.text)}".encode())
    before, after = notice.text.split(notice.name, 1)
    # a whole word, unless the space to the notice's own next word is what was lost
    left = rf"(?:(?<![0-9a-z\x80-\xff])|(?<={before.split()[-1]}))" if before.split() else r"(?<![0-9a-z\x80-\xff])"
    right = rf"(?:(?![0-9a-z\x80-\xff])|(?={after.split()[0]}))" if after.split() else r"(?![0-9a-z\x80-\xff])"
    return regex.compile(f"(?b){side(before)}{left}{regex.escape(notice.name, special_only=True)}{right}{side(after)}".encode())


def pieces(text: bytes, n: int) -> list[tuple[int, bytes]]:
    """text in n runs of about equal length, with their starts."""
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def finds(data: bytes, what: bytes) -> Iterator[int]:
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        by_size = sorted(notices, key=lambda n: -len(n.text))
        self.notices = [(n, pieces(n.text.encode(), n.edits + 1), pattern_of(n)) for n in by_size]

    def exact(self, data: bytes, start: np.ndarray, end: np.ndarray, doc_first: np.ndarray) -> list[tuple[int, int, str]]:
        """(word number in the chunk, document, label) of each place of a phrase."""
        out = []
        for words, label in self.phrases:
            rare = max(range(len(words)), key=lambda i: (len(words[i]), i))  # the longest stands for the rarest
            seen = set()
            for at in finds(data, words[rare]):
                i = int(np.searchsorted(start, at, "right")) - 1 - rare
                if i < 0 or i + len(words) > len(start) or i in seen:
                    continue
                doc = int(np.searchsorted(doc_first, i, "right")) - 1
                if i + len(words) <= doc_first[doc + 1] and all(data[start[i + k] : end[i + k]] == w for k, w in enumerate(words)):
                    seen.add(i)
                    out.append((i, doc, label))
        return out

    def fuzzy(self, data: bytes, off: np.ndarray) -> list[tuple[int, int, int, str, int, float]]:
        """(document, start byte, end byte, label, edits, score) of the matches; spans of a notice don't overlap."""
        out = []
        longer: dict[str, list[tuple[list[int], list[int]]]] = {}  # per label, the spans of each notice so far
        for notice, parts, pattern in self.notices:
            size, done = len(notice.text), -1
            starts: list[int] = []
            ends: list[int] = []
            near = sorted({at - a for a, piece in parts for at in finds(data, piece)})
            for at in near:
                doc = int(np.searchsorted(off, max(at, 0), "right")) - 1
                # the piece, not the notice's guessed start, decides the text it stands in
                lo, hi = max(at - notice.edits, done, 0), min(at + size + notice.edits + 1, len(data))  # one byte more shows where a name ends
                if hi <= lo or at + size <= done:
                    continue
                for d in range(max(doc, 0), min(int(np.searchsorted(off, hi, "left")), len(off) - 1)):
                    a, b = max(lo, int(off[d])), min(hi, int(off[d + 1]))
                    base = a if a == off[d] else 0  # the text before ends no word of this one
                    if b - a >= size - notice.edits and (m := pattern.search(data[a:b]) if base else pattern.search(data, a, b)):
                        x, y = m.start() + base, m.end() + base
                        edits = sum(m.fuzzy_counts)
                        if edits > notice.edits:
                            continue
                        done = max(done, y)
                        if any((k := bisect_right(own, x)) and to[k - 1] >= y for own, to in longer.get(notice.label, ())):
                            continue
                        starts.append(x)
                        ends.append(y)
                        out.append((d, x, y, notice.label, edits, 1 - edits / size))
            longer.setdefault(notice.label, []).append((starts, ends))
        return out


SCHEMA = "_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, span_labels array<string>, span_starts array<long>, span_ends array<long>, span_edits array<int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per input row, see SCHEMA; spans are of the fuzzy matches, in bytes of the lower-cased UTF-8 text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(phrases, notices)
        for batch in batches:
            for i, j, raw, off in chunks(batch.column(1)):
                buf = LOWER[raw]
                start, end, first = spans(buf, off, ALNUM_WORDS)
                n = j - i
                base, data = np.zeros(n, np.int64), buf.tobytes()
                low, high = np.full(n, 2**62), np.full(n, -1)
                names: dict[int, set[str]] = {}
                score = np.zeros(n)
                for w, d, label in s.exact(data, start, end, first):
                    base[d] += 1
                    low[d], high[d] = min(low[d], w - first[d]), max(high[d], w - first[d])
                    names.setdefault(d, set()).add(label)
                    score[d] = 1
                more = {d: set(x) for d, x in names.items()}
                found: dict[int, list] = {}
                for d, a, b, label, edits, value in s.fuzzy(data, off):
                    more.setdefault(d, set()).add(label)
                    found.setdefault(d, []).append((label, a - int(off[d]), b - int(off[d]), edits))
                    score[d] = max(score[d], value)
                none = base == 0
                join = lambda x: [",".join(sorted(x.get(d, ()))) for d in range(n)]
                col = lambda k, t: pa.array([[f[k] for f in found.get(d, ())] for d in range(n)], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(first)), pa.array(base), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(join(names), pa.string()), pa.array(join(more), pa.string()), pa.array(score), col(0, pa.string()), col(1, pa.int64()), col(2, pa.int64()), col(3, pa.int32())],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.selectExpr(f"cast(`{id_col}` as long) _id", f"`{text_col}` _text").mapInArrow(run, SCHEMA)
