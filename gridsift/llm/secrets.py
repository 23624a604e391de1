"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query of trigrams is derived that holds for every text
the regex matches in.  Each slice of texts gets an index of its own: for every trigram
that some query names, the sorted numbers of the texts that hold it.  A query
intersects and unites these postings, and only the texts left are matched.  Rules
without a mandatory trigram scan all texts.  The index covers ASCII-lower-cased bytes,
so it serves patterns of either letter case.

A text of any length is matched in time that grows with its length: rules whose regex would
be tried again at every sign of a run have a search of their own, with the same matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm.words import LOWER, small_slices, text_buffers
from gridsift.session import ship_package

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``find`` gives the matches (start, end) of a text as ``pattern`` would, where that takes too long.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None


def _urls(text: str) -> Iterator[tuple[int, int]]:
    """From each ``://`` forward, then back over the scheme, never into an earlier match."""
    end = 0
    for mark in re.finditer("://", text):
        if not (tail := _URL_TAIL.match(text, mark.start())):
            continue
        start = mark.start()
        while start > end and text[start - 1] in _SCHEME:
            start -= 1
        if first := _LETTER.search(text, start, mark.start()):
            end = tail.end()
            yield first.start(), end


_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_LETTER = re.compile("[a-z]")
_URL_TAIL = re.compile(r"://[^\s:/@]+:[^\s:/@]{3,}@", re.ASCII)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three runs of token signs with dots between; each run is looked at once."""
    runs = [m.span() for m in re.finditer("[A-Za-z0-9_-]+", text)]
    k = 0
    while k + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[k : k + 3]
        k += 1
        if text[b] != "." or c != b + 1 or text[d] != "." or e != d + 1 or not text.startswith("eyJ", c) or d - c < 11 or f - e < 8:
            continue
        # The first run may begin before its head.
        if (start := text.find("eyJ", a, max(b - 8, 0))) >= 0:
            yield start, f
            k += 2


#: The base kinds, in the order of their contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of 32 or more: the same as the runs of any length less those that are shorter.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Published shapes of further credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", find=_tokens),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]{3,}@", find=_urls),
)

# A query is True (any text), ("and", queries), ("or", queries) or a trigram.


def both(*queries):
    real = tuple(dict.fromkeys(q for q in queries if q is not True))
    return True if not real else real[0] if len(real) == 1 else ("and", real)


def either(queries):
    queries = tuple(dict.fromkeys(queries))
    return True if not queries or True in queries else queries[0] if len(queries) == 1 else ("or", queries)


def of_strings(strings: set[bytes]):
    """One of the strings occurs."""
    return either(both(*(s[k : k + 3] for k in range(len(s) - 2))) if len(s) > 2 else True for s in sorted(strings))


def _strings(tree) -> set[bytes] | None:
    """All strings a pattern stands for, if they are few."""
    found = {b""}
    for op, value in tree:
        if op is sre.LITERAL:
            own = {chr(value).lower().encode()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            own = {chr(v).lower().encode() for _, v in value}
        elif op is sre.SUBPATTERN:
            own = _strings(value[3])
        elif op is sre.BRANCH:
            parts = [_strings(x) for x in value[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] is not sre.MAXREPEAT and value[1] <= 8 and (once := _strings(value[2])) is not None:
            own, run = set(), {b""}
            for times in range(value[1] + 1):
                own |= run if times >= value[0] else set()
                run = {a + b for a in run for b in once}
                if len(run) > MOST_STRINGS:
                    return None
        else:
            own = None
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _query(tree):
    needs, run = [], {b""}
    for op, value in tree:
        own = _strings([(op, value)])
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        needs.append(of_strings(run))
        run = {b""} if own is None else own
        if op is sre.SUBPATTERN:
            needs.append(_query(value[3]))
        elif op is sre.BRANCH:
            needs.append(either([_query(x) for x in value[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            needs.append(_query(value[2]))
    return both(*needs, of_strings(run))


def trigram_query(rule: Rule):
    return _query(parser.parse(rule.pattern, rule.flags))


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def _found_by(rule: Rule) -> Callable[[str], Iterator[tuple[int, int]]]:
    pattern = re.compile(rule.pattern, rule.flags)
    return lambda text: (m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.kind, r.find or _found_by(r), trigram_query(r)) for r in rules]
        self.trigrams = sorted(set().union(*(trigrams_of(r[2]) for r in self.rules)))
        self.number = np.zeros(1 << 24, np.uint16)
        for k, (a, b, c) in enumerate(self.trigrams):
            self.number[a | b << 8 | c << 16] = k + 1

    def postings(self, texts: pa.Array) -> dict[bytes, np.ndarray]:
        """The sorted numbers of the texts that hold each named trigram."""
        data, offsets = text_buffers(texts)
        if len(data) < 3:
            return {t: np.zeros(0, np.int64) for t in self.trigrams}
        wide = LOWER[data].astype(np.uint32)
        found = self.number[wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)]
        at = np.flatnonzero(found)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        at, doc = at[inside], doc[inside]
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + doc)
        cuts = np.searchsorted(pairs, np.arange(1, len(self.trigrams) + 2) * len(texts))
        return {t: pairs[cuts[k] : cuts[k + 1]] % len(texts) for k, t in enumerate(self.trigrams)}

    def candidates(self, query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[query]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each text, in order."""
        postings, out = self.postings(texts), [[] for _ in range(len(texts))]
        plain: list = texts.to_pylist()
        for number, (_, find, query) in enumerate(self.rules):
            for doc in self.candidates(query, postings, len(texts)).tolist():
                out[doc] += [(start, number, end) for start, end in find(plain[doc] or "")]
        for spans in out:
            spans.sort()
        return out


def _scanned(rules: tuple[Rule, ...]):
    kinds = [r.kind for r in rules]
    base = len(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in small_slices(batch, 1):
                columns: list[list] = [[] for _ in range(base + 2)]
                for spans in scanner.scan(part.column(1)):
                    for k in range(base):
                        columns[k].append(sum(s[1] == k for s in spans))
                    said = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
                    own = ",".join(x for x, s in zip(said, spans, strict=True) if s[1] < base)
                    columns[base].append(hashlib.sha256(own.encode()).hexdigest())
                    columns[base + 1].append(",".join(said))
                kind = [pa.int64()] * base + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, kind)], ["id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"])

    return run


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then by the
    order of the rules; ``base_sha256`` is the digest of the base kinds' part of it.  A
    null text counts as empty and has no spans; an empty table gives no rows.  Ids are cast
    to long; rows without id and repeated ids are rows of their own; other columns are not
    read.  A text of any length is scanned whole; a task holds a slice of about two megabytes,
    or one text.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = slim.mapInArrow(_scanned((*BASE, *more)), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)
