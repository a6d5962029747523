"""Text functions as Column expressions: normalisers, guards, classifiers, parsers. All stay in the JVM."""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, functions as F

# Word lists and patterns that decide results.
HOP_CUES = ("and", "after", "before", "then", "which", "whose", "where", "when", "first", "second", "former", "latter", "that", "who")
ANAPHORA = (r"\bit\b", r"\bthis\b", r"\bthat\b", r"\bthese\b", r"\bthose\b", r"\bthe same\b", r"\bsame one\b", r"\bsame entity\b")
MISSING_ANSWERS = ("unknown", "none", "not known", "not stated", "no answer")
HASH_LIKE = r"(?i)\b(?:entity-)?[0-9a-f]{32}\b"
PLACEHOLDER = r"\$\{([A-Za-z][\w-]*)\.answer\}"
STRUCTURE_CLASSES = (
    ("parallel_or_comparison", r"\b(both|either|which of the two|older|younger|earlier|later|larger|smaller|taller|longer|same|more|fewer)\b"),
    ("nested_relation", r"\b(whose|that|which|who)\b.+\b(was|is|were|are|has|had|wrote|directed|born|located)\b"),
    ("time_or_quantity", r"\b(when|year|date|month|day|how many|how old|how long)\b"),
    ("location", r"\b(where|country|city|state|town|county|place)\b"),
)
TERMINAL_CLASSES = (
    ("date_or_time", r"\bwhen\b|\b(what|which) (year|date|month|day)\b"),
    ("quantity", r"\bhow (many|much|old|long|far|often|tall)\b|\b(population|height|age)\b"),
    ("comparison", r"\b(older|younger|earlier|later|larger|smaller|taller|more|fewer|longer)\b"),
    ("location", r"\bwhere\b|\b(what|which) (city|country|state|town|place|continent|county)\b"),
    ("creator", r"\b(author|writer|director|composer)\b|\bwho (wrote|directed|composed|created)\b"),
    ("affiliation", r"\b(team|club|university|college|school|company|party|organization|employer)\b"),
    ("work_or_object", r"\b(film|movie|book|novel|song|album|show|series|building|award)\b"),
    ("reason", r"\bwhy\b"),
    ("manner", r"^how\b"),
    ("identity", r"\b(who|whom|whose)\b"),
    ("property", r"^\s*(what|which)\b"),
)
TRUE_WORDS = ("yes", "true", "t", "y", "1")
COORDINATORS = ("and", "or", "but", "nor", "as well as")


def ascii_norm(c: Column) -> Column:
    """Lower case; other than ASCII letters, digits and space becomes space; inner spaces stay."""
    return F.trim(F.regexp_replace(F.lower(c), "[^A-Za-z0-9 ]", " "))


def unicode_norm(c: Column) -> Column:
    """Lower case; letters and digits of any script; white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", " "), r"\s+", " "))


def evidence_norm(c: Column) -> Column:
    """Word characters joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def surface_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))  # white space is among these characters


def answer_norm(c: Column) -> Column:
    """Lower case without punctuation and articles."""
    bare = F.translate(F.lower(c), string.punctuation, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def plural_stem(c: Column) -> Column:
    """Drops a final s of words over four letters that do not end in ss or us."""
    return F.when((F.length(c) > 4) & c.endswith("s") & ~c.endswith("ss") & ~c.endswith("us"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def hash_id(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.md5(c))


def tokens(c: Column) -> Column:
    """Tokens of normalised text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def contains_phrase(phrase: Column, text: Column) -> Column:
    """Whole-token containment of normalised text; an empty phrase is in nothing."""
    return (F.length(phrase) > 0) & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def short_label(c: Column) -> Column:
    """Labels of at most two ASCII letters or digits: these get no synonym edges."""
    return F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) <= 2


def hop_keywords(c: Column) -> Column:
    """How many cue phrases a question holds."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return functools.reduce(lambda a, b: a + b, (F.contains(padded, F.lit(f" {cue} ")).cast("int") for cue in HOP_CUES))


def keyword_hops(c: Column) -> Column:
    n = hop_keywords(c)
    return F.when(n <= 1, 1).when(n <= 4, 2).otherwise(3)


def bucket_hops(c: Column) -> Column:
    return F.when(c >= 5, "5+").otherwise(c.cast("string"))


def _first_class(c: Column, classes: tuple, otherwise: str) -> Column:
    text = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    out = None
    for name, pattern in classes:
        out = (F if out is None else out).when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def question_structure(c: Column) -> Column:
    return _first_class(c, STRUCTURE_CLASSES, "other_relation")


def terminal_attribute(c: Column) -> Column:
    return _first_class(c, TERMINAL_CLASSES, "other")


def first_line(c: Column) -> Column:
    """First line with a visible character: a passage's title."""
    return F.get(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), F.lit(0))


def snippet(text: Column, term: Column, before: int = 160, after: int = 240, otherwise: int = 400) -> Column:
    """Text around the first place of a term, or the beginning."""
    at = F.call_function("instr", F.lower(text), F.lower(term))
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, begin, at - begin + F.length(term) + after)).otherwise(F.substring(text, 1, otherwise))


def rewrite_anaphora(question: Column, anchor: str) -> Column:
    safe = anchor.replace("\\", "\\\\").replace("$", "\\$")
    return functools.reduce(lambda q, p: F.regexp_replace(q, f"(?i){p}", safe), ANAPHORA, question)


def bind_placeholders(question: Column, bindings: Column) -> Column:
    """Replaces each ${id.answer}; null if one is unbound or its value looks like an internal id."""
    refs = F.regexp_extract_all(question, F.lit(PLACEHOLDER), F.lit(1))
    usable = F.forall(refs, lambda r: F.map_contains_key(bindings, r) & ~F.coalesce(F.try_element_at(bindings, r), F.lit("")).rlike(HASH_LIKE))
    bound = F.aggregate(F.map_entries(bindings), question, lambda q, e: F.replace(q, F.concat(F.lit("${"), e["key"], F.lit(".answer}")), e["value"]))
    return F.when(usable, bound)


def branch_matches(requirements: Column, bindings: Column) -> Column:
    return F.forall(F.map_entries(requirements), lambda e: F.coalesce(evidence_norm(e["value"]) == evidence_norm(F.try_element_at(bindings, e["key"])), F.lit(False)))


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:18|19|20)\d\d)\b"), F.lit(1)))


def year_conflict(a: Column, b: Column) -> Column:
    return (F.size(years(a)) > 0) & (F.size(years(b)) > 0) & ~F.arrays_overlap(years(a), years(b))


def named_spans(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Za-z0-9'.-]*(?: [A-Z][A-Za-z0-9'.-]*)*)"), F.lit(1)), lambda x: ~x.isin("Which", "Who", "What", "When", "Where", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Has", "Have", "In", "On"))


def subject_members(c: Column) -> Column:
    """Members of a coordinated subject."""
    return F.filter(F.transform(F.split(c, r"(?i)\s*,\s*|\s+(?:and|or|&|as well as)\s+"), lambda x: F.trim(x)), lambda x: x != "")


def section(response: Column, field: str) -> Column:
    """The block under [[ ## field ## ]] of a sectioned response."""
    return F.regexp_extract(response, rf"(?s)\[\[ ## {field} ## \]\]\s*(.*?)\s*(\[\[ ##|$)", 1)


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: x != "")


def sub_questions(c: Column, at_most: int = 3) -> Column:
    """Lines of a list without bullets and numbers."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-*0-9.) (]+", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, at_most)


def ngrams(words: Column, longest: int = 5) -> Column:
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words)))
    grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return F.when(F.size(words) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUE_WORDS)


def finite(c: Column, default: float = 0.0) -> Column:
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def json_object(c: Column) -> Column:
    """The whole text as JSON, else its outermost braces; null if neither parses."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def valid_triples(triples: Column) -> Column:
    """Lists of exactly three parts with a letter or digit each and no mere coordinator as predicate; stripped, first of equals kept."""
    stripped = F.transform(triples, lambda t: F.transform(t, lambda f: F.trim(f)))
    good = F.filter(stripped, lambda t: (F.size(t) == 3) & F.forall(t, lambda f: F.coalesce(f.rlike(r"[\p{L}\p{N}]"), F.lit(False))) & ~F.lower(F.get(t, F.lit(1))).isin(*COORDINATORS))
    return F.array_distinct(good)
