"""License scans by ordered signature rules.

Text is lower-cased (A-Z) and read as words, runs of letters, digits and characters from U+0080; rules are regular
expressions over the words joined by single spaces. A rule runs only if for each of its keywords the text has one of the
words that the pattern can show in its place. Signatures of licence texts and notices come first, then names of licences
in words of licensing, then bare names. Of overlapping detections the one of higher priority, then the longer one, wins,
and a detection that lies inside one already taken is suppressed.

The base places (fixed phrases) are counted apart and never suppressed. A null text is empty: no words, no labels,
score 0. Repeated rows are scanned each; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopweave.llm.hashing import byte_list
from hopweave.llm.license_passages import SIGNATURES

# The base phrases and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

V = r"(?: version| v)?"
# Label, keyword (words that may stand for it are parted by |), how the licence is named. Longer names first where one begins another.
LICENSES = (
    ("AGPL-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e{V}(?: 3(?: 0)?)?"),
    ("AGPL-3.0", "agpl|agplv3|agpl3", rf"agpl(?:v| v| )?3(?: 0)?"),
    ("LGPL-2.1", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 2 1"),
    ("LGPL-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 3(?: 0)?"),
    ("LGPL-2.0", "library", rf"(?:gnu )?library general public licen[sc]e(?:{V} 2(?: 0)?)?"),
    ("LGPL-2.1", "lgpl|lgplv2|lgpl2", r"lgpl(?:v| v| )?2 1"),
    ("LGPL-3.0", "lgpl|lgplv3|lgpl3", r"lgpl(?:v| v| )?3(?: 0)?"),
    ("GPL-2.0", "general", rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)?"),
    ("GPL-3.0", "general", rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)?"),
    ("GPL", "general", r"(?:gnu )?general public licen[sc]e"),
    ("GPL-2.0", "gpl|gplv2|gpl2", r"(?:gnu )?gpl(?:v| v| )?2(?: 0)?"),
    ("GPL-3.0", "gpl|gplv3|gpl3", r"(?:gnu )?gpl(?:v| v| )?3(?: 0)?"),
    ("GFDL-1.3", "documentation", rf"(?:gnu )?free documentation licen[sc]e(?:{V} 1 3)?"),
    ("Apache-2.0", "apache", rf"apache (?:software )?licen[sc]e{V} 2(?: 0)?"),
    ("Apache-1.1", "apache", rf"apache (?:software )?licen[sc]e{V} 1 1"),
    ("Apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("MIT-0", "mit", r"mit no attribution(?: licen[sc]e)?"),
    ("MIT", "mit", r"mit licen[sc]e"),
    ("MIT", "expat", r"expat licen[sc]e"),
    ("X11", "x11", r"(?:mit )?x11 licen[sc]e"),
    ("ISC", "isc", r"isc licen[sc]e"),
    ("BSD-4-Clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?"),
    ("BSD-3-Clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("BSD-2-Clause", "bsd|freebsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("0BSD", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("0BSD", "bsd", r"(?:zero|0) clause bsd(?: licen[sc]e)?"),
    ("BSD", "bsd", r"bsd (?:style )?licen[sc]e"),
    ("MPL-2.0", "mozilla", rf"mozilla public licen[sc]e{V} 2(?: 0)?"),
    ("MPL-1.1", "mozilla", rf"mozilla public licen[sc]e{V} 1 1"),
    ("MPL", "mozilla", r"mozilla public licen[sc]e"),
    ("MPL-2.0", "mpl", r"mpl(?: v)? 2 0"),
    ("EPL-2.0", "eclipse", rf"eclipse public licen[sc]e{V} 2(?: 0)?"),
    ("EPL-1.0", "eclipse", rf"eclipse public licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("EUPL-1.2", "union", rf"european union public licen[sc]e(?:{V} 1 2)?"),
    ("CDDL-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("CDDL-1.0", "distribution", r"common development and distribution licen[sc]e"),
    ("CPL-1.0", "common", r"common public licen[sc]e"),
    ("BSL-1.0", "boost", r"boost software licen[sc]e"),
    ("BUSL-1.1", "business", r"business source licen[sc]e"),
    ("SSPL-1.0", "server", r"server side public licen[sc]e"),
    ("Elastic-2.0", "elastic", r"elastic licen[sc]e(?: 2 0)?"),
    ("Artistic-2.0", "artistic", rf"artistic licen[sc]e{V} 2(?: 0)?"),
    ("Artistic-1.0", "artistic", r"artistic licen[sc]e"),
    ("Zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("Unlicense", "unlicense", r"unlicense"),
    ("WTFPL", "wtfpl", r"wtfpl"),
    ("Python-2.0", "python", r"python software foundation licen[sc]e"),
    ("PHP-3.01", "php", r"php licen[sc]e"),
    ("Ruby", "ruby", r"ruby licen[sc]e"),
    ("PostgreSQL", "postgresql", r"postgresql licen[sc]e"),
    ("OpenSSL", "openssl", r"openssl licen[sc]e"),
    ("OFL-1.1", "font", r"(?:sil )?open font licen[sc]e(?: 1 1)?"),
    ("NCSA", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("Ms-PL", "microsoft", r"microsoft public licen[sc]e"),
    ("Ms-RL", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("OSL-3.0", "open", r"open software licen[sc]e(?: 3 0)?"),
    ("AFL-3.0", "academic", r"academic free licen[sc]e(?: 3 0)?"),
    ("ODbL-1.0", "database", r"open database licen[sc]e"),
    ("ODC-BY", "commons", r"open data commons attribution licen[sc]e"),
    ("CC0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("CC0-1.0", "zero", r"creative commons zero"),
    ("OpenRAIL", "openrail", r"(?:creativeml )?openrail(?: m)?(?: licen[sc]e)?"),
    ("Proprietary", "proprietary", r"proprietary (?:licen[sc]e|and confidential)"),
    ("Public-Domain", "domain", r"(?:in|to|into) the public domain|public domain (?:dedication|work)"),
)
# Creative Commons: each set of conditions, in short and in words, in each version.
CONDITIONS = (
    ("BY-NC-ND", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
    ("BY-NC-SA", "by nc sa", "attribution non ?commercial share ?alike"),
    ("BY-NC", "by nc", "attribution non ?commercial"),
    ("BY-ND", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("BY-SA", "by sa", "attribution share ?alike"),
    ("BY", "by", "attribution"),
)
VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0", "")
# Labels whose names mean a licence only in so many words, and those that are also names of software.
NO_IDENTIFIER = ("Public-Domain", "Proprietary")
SOFTWARE = ("X11", "Python-2.0", "PHP-3.01", "Ruby", "PostgreSQL", "OpenSSL")


def identifiers() -> list[tuple[str, str, str]]:
    """Label, keyword and pattern of identifiers (MIT, Apache-2.0) that no name above covers; they count only after words of licensing."""
    out = []
    for label in dict.fromkeys(x[0] for x in LICENSES if x[0] not in NO_IDENTIFIER):
        words = re.sub("[^a-z0-9]+", " ", label.lower())
        if any(known == label and re.fullmatch(pattern, words) for known, _, pattern in LICENSES):
            continue
        name, number = re.fullmatch(r"(.*?)((?: \d+)+)?", words).groups()
        pattern = ("(?:gnu )?" if "gpl" in name or name == "gfdl" else "") + name
        if label != "MIT-0" and number:
            pattern += "(?: version)? v?" + re.sub(" 0$", "(?: 0)?", number[1:])
        else:
            pattern += number or ""
        out.append((label, name.split()[0], pattern))
    return out


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[frozenset[bytes], ...]  # of each, one word must be there
    pattern: re.Pattern
    weight: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first. A name with words of licensing around it outranks the bare name."""
    frames = (
        (4, 0.99, r"spdx licen[sc]e identifier {}", "spdx"),
        (3, 0.95, r"(?:re)?licensed (?:\w+ ){{0,3}}?under (?:the )?(?:terms of the )?{}", "licensed|relicensed"),
        (3, 0.95, r"(?:released|distributed|available|published|provided|shared) (?:\w+ ){{0,3}}?under (?:the )?(?:terms of the )?{}", "under"),
        (1, 0.8, "{}", ""),
    )
    names = [(label, (keyword,), pattern) for label, keyword, pattern in LICENSES]
    for short, letters, long in CONDITIONS:
        for version in VERSIONS:
            number = " " + version.replace(".", " ") if version else ""
            label = "-".join(filter(None, ("CC", short, version)))
            names.append((label, ("cc",), rf"cc {letters}{number}"))
            names.append((label, ("creative", "commons"), rf"creative commons {long}(?: licen[sc]e)?(?: version)?{number}(?: international| unported)?"))
    bare = [(label, (keyword,), pattern) for label, keyword, pattern in identifiers()]
    out = [Rule(label, 5, (frozenset(word.encode().split(b"|")),), re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), 0.99) for label, word, pattern in SIGNATURES]
    for priority, weight, frame, extra in frames:
        for label, keywords, pattern in names + [x for x in bare if extra and not (extra == "under" and x[0] in SOFTWARE)]:
            need = tuple(frozenset(k.encode().split(b"|")) for k in (*keywords, extra) if k)
            out.append(Rule(label, priority, need, re.compile((r"(?<= )" + frame.format(f"(?:{pattern})") + r"(?= )").encode()), weight))
    return tuple(out)


_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@lru_cache(maxsize=1)
def _by_word() -> dict[bytes, list[Rule]]:
    """Rules by the words of their first keyword."""
    out: dict[bytes, list[Rule]] = {}
    for r in rules():
        for word in r.keywords[0]:
            out.setdefault(word, []).append(r)
    return out


def detections(joined: bytes, present: set[bytes]) -> list[tuple[int, int, Rule]]:
    """What is left after suppression, in order of place; ``joined`` has a space at either end."""
    near = {id(r): r for word in present for r in _by_word().get(word, ())}.values()
    found = [(m.start(), m.end(), r) for r in near if not any(k.isdisjoint(present) for k in r.keywords) for m in r.pattern.finditer(joined)]
    taken, cover = [], bytearray(len(joined))
    for start, end, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
        if 1 not in cover[start:end]:
            cover[start:end] = b"\x01" * (end - start)
            taken.append((start, end, rule))
    return sorted(taken, key=lambda x: (x[0], x[1]))


def scan(text: bytes, keywords: frozenset[bytes]) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    words = text.translate(_TO_SPACE).split()
    if keywords.isdisjoint(words):
        return len(words), 0, None, None, [], [], 0.0
    joined, places, base = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in BASE:
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(b" " + phrase + b" ", at + 1)
    taken = detections(joined, keywords.intersection(words))
    labels = base | {r.label for _, _, r in taken}
    score = max([r.weight for _, _, r in taken] + [0.6] * bool(base), default=0.0)
    first, last = (joined.count(b" ", 0, f(places)) if places else None for f in (min, max))
    return len(words), len(places), first, last, sorted(base), sorted(labels), score


@lru_cache(maxsize=1)
def gate() -> frozenset[bytes]:
    """Words without one of which no rule and no base phrase can match."""
    return frozenset(word for r in rules() for k in r.keywords for word in k) | {p.split()[0] for p, _ in BASE}


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t, gate()) for t in byte_list(batch.column(1))]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array([",".join(x) for x in c], pa.string()) for c in columns[4:6]), pa.array(columns[6], pa.float64())],
            names=[c.split()[0] for c in _SCHEMA.split(", ")],
        )


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_scan, _SCHEMA)
