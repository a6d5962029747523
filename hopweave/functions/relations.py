"""Questions and claims: what relation a question asks, and whether a sentence of a source bears a claim out.

Fixed vocabularies name the relations; everything else is token spans of one sentence, so a claim is never joined across
sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from hopweave.functions.repair import quote_offsets, source_units, strip_accents

# Words by which a question or a sentence names each relation.
RELATIONS = {
    "author": ("wrote", "written", "author", "writer"),
    "director": ("directed", "director"),
    "composer": ("composed", "composer"),
    "producer": ("produced", "producer"),
    "publisher": ("published", "publisher"),
    "performer": ("performed", "performer", "sang", "singer"),
    "founder": ("founded", "founder"),
    "spouse": ("married", "spouse", "wife", "husband"),
    "mother": ("mother",),
    "father": ("father",),
    "birth_place": ("born", "birthplace"),
    "birth_date": ("born", "birthdate"),
    "death_date": ("died", "death"),
    "capital": ("capital",),
    "location": ("located", "situated", "in"),
}
YEAR = re.compile(r"\b(?:1[0-9]|20)\d\d\b")


@dataclass(frozen=True)
class Relation:
    name: str
    subject: str


def relation_of(question: str) -> Relation | None:
    """The relation that a one-hop question asks, and of what; None where no word of the vocabulary occurs."""
    words = strip_accents(question).split()
    place, date = "where" in words, "when" in words or "year" in words or "date" in words
    for name, cues in RELATIONS.items():
        if name == "birth_place" and date or name == "birth_date" and not date or name in ("death_date",) and place:
            continue
        cue = next((w for w in words if w in cues), None)
        if cue and name != "location":
            names = re.findall(r"\b[A-Z][\w'.-]*(?:\s+[A-Z][\w'.-]*)*", question)
            names = [n for n in names if n.split()[0] not in ("Who", "What", "When", "Where", "Which", "Whose", "In")]
            return Relation(name, names[-1] if names else "")
    return None


def witness(question: str, answer: str, quote: str, document: str) -> tuple[str, str, int, int]:
    """(status, reason, start, end): supported if one sentence that overlaps the quote names the subject, the answer and
    the relation; contradicted if such a sentence has another year where the answer is one; unknown otherwise."""
    spec, places = relation_of(question), quote_offsets(document, quote)
    if not places:
        return "unknown", "quote_not_in_source", -1, -1
    start, end = places[0]
    if spec is None:
        return "unknown", "relation_not_known", start, end
    title = document.split("\n", 1)[0]
    for a, b in source_units(document):
        if a < end and start < b:
            unit = document[a:b]
            words = set(strip_accents(unit).split())
            about = not spec.subject or quote_offsets(unit, spec.subject) or quote_offsets(title, spec.subject)
            if not about or not words & set(RELATIONS[spec.name]):
                continue
            if quote_offsets(unit, answer):
                return "supported", "same_sentence", start, end
            if YEAR.fullmatch(answer.strip()) and YEAR.findall(unit):
                return "contradicted", "other_year", start, end
    return "unknown", "no_sentence_bears_it", start, end


def typed_reason(answer: str, answer_type: str) -> str | None:
    """Why an answer cannot be of its type, if so."""
    kind = strip_accents(answer_type)
    if kind in ("date", "year", "time") and not re.search(r"\d", answer):
        return "not_a_time"
    if kind in ("number", "count", "quantity") and not re.search(r"\d|\b(one|two|three|four|five|six|seven|eight|nine|ten)\b", answer, re.I):
        return "not_a_number"
    if kind in ("person", "place", "location", "city", "country") and re.fullmatch(r"[\d\W]+", answer):
        return "not_a_name"
    return None


def repair_reason(query: str, nodes: list[dict]) -> str | None:
    """Why a repaired plan does not keep to its question: numbers, quoted names or names of its own."""
    said = " ".join(n["question"] for n in nodes)
    plain = re.sub(r"\$\{[^}]*\}", " ", said)
    for pattern, reason in ((r"\d+", "number_lost"), (r"\"([^\"]+)\"", "quoted_name_lost")):
        if any(x not in said for x in re.findall(pattern, query)):
            return reason
    known = strip_accents(query).split()
    names = [w for w in re.findall(r"(?<!^)(?<![.?!]\s)\b[A-Z]\w+", plain) if strip_accents(w) not in known]
    return "name_introduced" if names else None


def recovery_kind(nodes: list[dict], bound: set[str]) -> str:
    """What an unresolved plan needs: nothing, one more hop, another start, or another end."""
    open_ = [n for n in nodes if n["id"] not in bound]
    if not open_:
        return "complete"
    if not bound:
        return "restart"
    used = {d for n in nodes for d in n["depends_on"]}
    return "terminal_missing" if all(n["id"] not in used for n in open_) else "bridge_missing"
