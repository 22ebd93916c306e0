"""Secret scan: labelled and formatted secrets by pattern, unlabelled ones by sliding-window entropy.

Base kinds are patterns: ``assign`` (a keyword, a separator and a value of six characters or more), ``access`` (access
key ids of 20 characters or more) and ``hex`` (24 lower-case hex digits or more).

The entropy kinds look at candidate strings, the maximal runs of token characters. Within a candidate each character
class (hex digits; letters and digits; letters, digits and the signs of base 64) has its own window length and least
Shannon entropy. A window slides over every maximal run of the class: the sum of ``c * log2 c`` over the counts of
its characters changes by one count that falls and one that rises, so each step costs the same however long the
window, and the entropy is ``log2 w - sum / w``. Sums are integers (millionths of a bit), so a verdict never depends
on where a window starts to be counted. Windows at or above the least entropy are joined where they overlap. Candidates on
the allow-list are suppressed: words that mark examples, plain alphabets, and paths or slugs of words and short
numbers. A span that overlaps a base span or one of an earlier class is not reported again; base spans always stay.

One pass over the texts in Arrow batches, no shuffle. Each text is scanned whole; a candidate is scanned in blocks
that overlap by a window, so memory does not follow its length.

Defined cases: null text counts as empty; every row gets a row, also repeated rows, null ids and empty texts; an empty
table gives an empty result; all other columns pass through in the struct ``_doc``, so no name can clash; positions
are code points. Ties: of spans with one start the kinds' order decides (base kinds, then classes, as listed).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def _either_case(words: str) -> str:
    """A pattern for words in any case of A-Z, with no other case folding."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")


class CharClass(NamedTuple):
    name: str
    chars: str  # as in a pattern's brackets
    window: int
    min_bits: float


#: Random strings reach about 3.5, 4.3 and 4.7 bits in these windows, running prose 3.3, 3.9 and 4.1.
CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 24, 3.1),
           CharClass("entropy_alnum", "A-Za-z0-9", 24, 4.1),
           CharClass("entropy_base64", "A-Za-z0-9+/_=-", 32, 4.45))

CANDIDATE = "[A-Za-z0-9+/_=-]"
_WORD = "(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4})"
#: A candidate that one of these finds is suppressed.
ALLOWED = (_either_case("example|sample|placeholder|dummy|changeme"),
           _either_case("abcdefghijklmnop|0123456789"),
           f"^[+/_=-]*{_WORD}(?:[+/_=-]+{_WORD})*[+/_=-]*$")

#: Steps of a window at a time; bounds the memory of a candidate's scan.
BLOCK = 1 << 18


def scaled_log(n: int) -> np.ndarray:
    """Millionths of ``c * log2 c`` for counts c from 0 to n, as integers."""
    c = np.arange(n + 1, dtype=np.float64)
    return np.round(c * np.log2(np.maximum(c, 1)) * 1e6).astype(np.int64)


def most_sum(window: int, min_bits: float) -> int:
    """The largest sum of a window that has at least ``min_bits`` of entropy."""
    return int(np.floor(window * (np.log2(window) - min_bits) * 1e6))


def window_sums(codes: np.ndarray, window: int, table: np.ndarray) -> np.ndarray:
    """Sum of ``c * log2 c`` of every window over the characters, by its changes from window to window."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)  # places sorted by character: the same character's places are consecutive
    rank[order] = np.arange(n)
    place = order + codes[order].astype(np.int64) * (n + window)  # ascending along the order
    at = np.arange(n)
    own = codes.astype(np.int64) * (n + window)
    # equal characters among the up to window - 1 before each place, and among the window - 1 after it
    before = rank - np.searchsorted(place, own + np.maximum(at - window + 1, 0))
    after = np.searchsorted(place, own + np.minimum(at + window, n)) - rank
    rise = table[before + 1] - table[before]
    fall = table[after - 1] - table[after]
    first = rise[:window].sum()  # the first window grows character by character
    # each next window loses its first character, then gains one; a count before the gain is that without the loss
    steps = fall[: n - window] + rise[window:]
    return first + np.concatenate([[0], np.cumsum(steps)])


def dense_spans(text: str, window: int, limit: int, table: np.ndarray) -> list[tuple[int, int]]:
    """Joined windows with a sum of at most ``limit``."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8)
    spans: list[tuple[int, int]] = []
    for start in range(0, len(codes) - window + 1, BLOCK):
        hits = start + np.flatnonzero(window_sums(codes[start : start + BLOCK + window - 1], window, table) <= limit)
        if not len(hits):
            continue
        cut = np.flatnonzero(np.diff(hits) > window)  # touching windows are joined
        for a, b in zip(hits[np.concatenate([[0], cut + 1])].tolist(), hits[np.concatenate([cut, [len(hits) - 1]])].tolist()):
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], b + window)
            else:
                spans.append((a, b + window))
    return spans


class Scanner:
    """Spans (start, kind number, end) of a text, by start and kind."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.kinds = (*BASE_KINDS, *(c.name for c in classes))
        shortest = min([c.window for c in classes] + [MIN_HEX])
        self.assign, self.access, self.hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
        self.candidate = re.compile(f"(?<!{CANDIDATE}){CANDIDATE}{{{shortest},}}")
        self.allowed = [re.compile(a) for a in allowed]
        self.classes = [(re.compile(f"[{c.chars}]{{{c.window},}}"), c.window, most_sum(c.window, c.min_bits), scaled_log(c.window))
                        for c in classes]

    def base(self, text: str, runs: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
        out = []
        low = text.lower()  # only to tell whether a keyword can be there
        if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
            out += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if len(m[0]) >= MIN_ACCESS]
        for at, run in runs:  # a run of 24 hex digits lies in a candidate
            out += [(at + m.start(), 2, at + m.end()) for m in self.hex.finditer(run) if len(m[0]) >= MIN_HEX]
        return sorted(out)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans."""
        runs = [(m.start(), m[0]) for m in self.candidate.finditer(text)]
        base = self.base(text, runs)
        found: list[tuple[int, int, int]] = []
        taken = [(s, e) for s, _, e in base]
        for kind, (pattern, window, limit, table) in enumerate(self.classes, len(BASE_KINDS)):
            more = []
            for at, run in runs:
                if not any(a.search(run) for a in self.allowed):
                    for m in pattern.finditer(run):
                        more += [(at + m.start() + s, at + m.start() + e) for s, e in dense_spans(m[0], window, limit, table)]
            more = _free(more, taken)
            found += [(s, kind, e) for s, e in more]
            taken += more
        return base, sorted(base + found)

    def written(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.kinds[k]}:{s}:{e}" for s, k, e in spans)


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of those taken."""
    if not spans or not taken:
        return spans
    by_start = sorted(taken)
    starts = np.array([s for s, _ in by_start])
    reach = np.maximum.accumulate([e for _, e in by_start])  # furthest end so far
    out = []
    for s, e in spans:
        before = int(np.searchsorted(starts, e))  # those that start before this one ends
        if not before or reach[before - 1] <= s:
            out.append((s, e))
    return out


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Rows of ``_doc``, _base and _spans: arrays of (kind, first, last) with code points, ``last`` exclusive."""
    struct = "array<struct<kind:string,first:bigint,last:bigint>>"
    rows = docs.select(C.as_struct(docs), C.whole_text(f"`{text}`").alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        listed = lambda spans: [{"kind": scanner.kinds[k], "first": s, "last": e} for s, k, e in spans]
        for batch in batches:
            for part in C.slices(batch, "_text"):
                found = [scanner.spans(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_doc"), pa.array([listed(b) for b, _ in found], kind), pa.array([listed(a) for _, a in found], kind)],
                    ["_doc", "_base", "_spans"])

    return rows.mapInArrow(run, f"_doc {rows.schema['_doc'].dataType.simpleString()}, _base {struct}, _spans {struct}")


def joined(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def n_of(kind: str, spans: str = "_base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask``; overlapping spans are replaced as one."""
    found = scan(docs)
    # spans stand by start: those that reach past all before them leave the text in front of them
    step = F.aggregate(
        "_spans", F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["last"] < s["at"], s).otherwise(F.struct(
            (x["last"] + 1).alias("at"),
            F.when(x["first"] + 1 >= s["at"], F.concat(s["out"], F.substring("_doc.text", s["at"], x["first"] + 1 - s["at"]), F.lit(mask)))
            .otherwise(s["out"]).alias("out"))),
        lambda s: F.concat(s["out"], F.substring("_doc.text", s["at"], F.char_length("_doc.text"))))
    return found.select(F.col("_doc").withField("text", F.when(F.size("_spans") > 0, step).otherwise(F.col("_doc.text"))).alias("_doc")).select("_doc.*")
