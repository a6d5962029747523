"""Personal data in texts: four base patterns, and spans of names, streets, identity numbers and dates of birth that a
conditional random field finds (see pii_field).

Base spans are leftmost, non-overlapping matches of each pattern; those that fail their test are dropped and not tried
again. Tokens that a base span touches are outside every other span, so the field's spans never overlap base ones.

Places are code points, ends exclusive. A null text is empty and has no spans; very long texts are scanned whole. Repeated
rows are scanned each, a null doc_id is a row like others, all columns of the caller pass through, and an empty table
gives an empty one. The field is trained anew on the driver from the labelled table (a hundred lines, some seconds).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from hopweave.llm.columns import as_row, from_row, quoted
from hopweave.llm.pii_examples import examples
from hopweave.llm.pii_field import BREAK, TOKEN, Field, train, viterbi

# The base patterns. Runs of digits and dots are taken whole (possessive), which changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
FOUND = ("birth", "id", "name", "street")
KINDS = BASE + FOUND
MOST_NAME_WORDS = 5
SLICE_CHARS = 8 << 20
MEMO_TOKENS = 1 << 18


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign @ with what stands before and after it: linear, also where long runs of letters hold none."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _is_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and _luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m[0])]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _holds(kind: str, span: str) -> bool:
    """What a span of the field must have at least."""
    digits = sum(c.isdigit() for c in span)
    if kind == "name":
        parts = span.split()
        return span[0].isupper() and not digits and len(span) > 1 and len(parts) <= MOST_NAME_WORDS and len(set(parts)) == len(parts)
    return digits >= {"id": 6, "birth": 4, "street": 1}[kind] and (kind != "street" or any(c.isalpha() for c in span))


class _Classes(dict):
    """Classes of tokens; those of equal features share one."""

    def __init__(self, model: Field):
        self.model, self.features, self.number = model, [], {}

    def __missing__(self, token: str) -> int:
        features = self.model.features(token)
        n = self.number.setdefault(features, len(self.features))
        if n == len(self.features):
            self.features.append(features)
        self[token] = n
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


class Scanner:
    def __init__(self, model: Field):
        self.model = model
        self.kind = [KINDS.index(k) if k else -1 for k in model.labels]
        self.classes = _Classes(model)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text; all texts make one chain, with breaks in between."""
        if len(self.classes) > MEMO_TOKENS:
            self.classes = _Classes(self.model)
        pad = self.classes.of([BREAK, BREAK])
        out, parts, barred, starts, at = [], [pad], [], [], 2
        for text in texts:
            tokens = TOKEN.findall(text)
            own, base = self.classes.of(tokens), base_spans(text)
            out.append(base)
            starts.append(at)
            if base:
                begin, end = (np.fromiter((f(m) for m in TOKEN.finditer(text)), np.int64, len(tokens)) for f in (re.Match.start, re.Match.end))
                cover = np.zeros(len(text) + 1, np.int64)
                for a, _, b in base:
                    cover[a] += 1
                    cover[b] -= 1
                covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
                barred.append(np.flatnonzero(covered[end] > covered[begin]) + at)
            parts += [own, pad]
            at += len(own) + 2
        chain = np.concatenate(parts)
        forced = chain == self.classes[BREAK]
        if barred:
            forced[np.concatenate(barred)] = True
        best = viterbi(self.model.emissions(self.classes.features, chain), self.model.moves, forced)
        inside = np.flatnonzero(best)
        if len(inside):
            owner = np.searchsorted(starts, inside, side="right") - 1
            for i in np.unique(owner).tolist():
                self._add(out[i], texts[i], inside[owner == i] - starts[i], best[inside[owner == i]])
        return out

    def _add(self, spans: list, text: str, places: np.ndarray, labels: np.ndarray) -> None:
        where = set(places.tolist())
        bounds = {i: (m.start(), m.end()) for i, m in enumerate(TOKEN.finditer(text)) if i in where}
        cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(labels) != 0)) + 1
        for run, own in zip(np.split(places, cut), np.split(labels, cut)):
            a, b, kind = bounds[int(run[0])][0], bounds[int(run[-1])][1], self.kind[int(own[0])]
            if _holds(KINDS[kind], text[a:b]):
                spans.append((a, kind, b))
        spans.sort()


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with [kind] in place of each span; of overlapping ones, the first by start and kind names the place."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@functools.cache
def default_field() -> Field:
    return train(examples())


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def _scan(model: Field, mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            begin = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or (size and size + len(texts[i] or "") > SLICE_CHARS):
                    part = batch.slice(begin, i - begin)
                    found = scanner.scan([t or "" for t in texts[begin:i]])
                    flat = [s for f in found for s in f]
                    cuts = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                    spans = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.int32()) for k in range(3)], fields=list(_SPAN))
                    columns = [part.column("row"), pa.ListArray.from_arrays(pa.array(cuts), spans)]
                    if mask:
                        columns.append(pa.array([t if t is None else masked(t, f) for t, f in zip(texts[begin:i], found)], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "pii_spans", "masked"][: len(columns)])
                    begin, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    return run


def _scanned(docs: DataFrame, text: str, model: Field | None, mask: bool) -> DataFrame:
    rows = as_row(docs, F.col(quoted(text)).alias("text"))
    schema = StructType([rows.schema["row"]]).add("pii_spans", DataType.fromDDL("array<struct<start:int,kind:int,end:int>>"))
    return rows.mapInArrow(_scan(model or default_field(), mask), schema.add("masked", "string") if mask else schema)


def find(docs: DataFrame, text: str = "text", model: Field | None = None) -> DataFrame:
    """docs with ``pii_spans`` (in place of a column of that name): an array of (start, kind, end), kind an index of KINDS,
    by start and then kind."""
    names = [c for c in docs.columns if c.lower() != "pii_spans"]
    return _scanned(docs, text, model, False).select(*[F.col("row")[c].alias(c) for c in names], "pii_spans")


def redact(docs: DataFrame, text: str = "text", model: Field | None = None) -> DataFrame:
    """docs with [kind] in place of each span of the text; a null text stays null."""
    return from_row(_scanned(docs, text, model, True), docs.columns, **{text: F.col("masked")})


def report(found: DataFrame) -> DataFrame:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    joined = f"array_join(transform({{}}, x -> concat(get({names}, x.kind), ':', x.start, ':', x.end)), ',')"
    count = [F.expr(f"bigint(size(filter(pii_spans, x -> x.kind = {k})))").alias(f"n_{BASE[k]}") for k in range(len(BASE))]
    return found.select(
        "doc_id", *count, F.expr(f"sha2({joined.format(f'filter(pii_spans, x -> x.kind < {len(BASE)})')}, 256)").alias("base_sha256"), F.expr(joined.format("pii_spans")).alias("spans")
    )
