"""Which shape a question has, read from a line of its words.

Words of names become one mark each, so that the shape shows as a line: "Which is older, Alpha Tower or Beta Hall?"
reads " which is older @ or @ ". All rules are patterns over that line, which is made once a question.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME = "@"
# Words that decide.
QUESTION_WORDS = ("which", "who", "whose", "whom", "what", "when", "where", "how")
AUXILIARIES = ("is", "are", "was", "were", "do", "does", "did", "has", "have", "had")
COMPARED = ("earlier", "later", "older", "younger", "first", "last", "more", "less", "longer", "shorter", "larger", "smaller", "bigger", "higher", "lower", "taller", "fewer", "closer", "farther", "different")
SHARED = ("same", "both", "share", "shared", "common")
HOLDERS = ("director", "producer", "writer", "author", "composer", "parent", "father", "mother", "spouse", "husband", "wife", "founder", "owner", "performer", "creator", "editor")


def marks(question: Column) -> Column:
    """Lower-case words with a space on either side, each run of capitalised words (and numbers in it) as one NAME; a
    question word or auxiliary at the beginning is no name."""
    raw = F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'.-]*"), F.lit(0))
    plain = F.transform(raw, lambda w: F.regexp_replace(w, r"('s|[.'-]+)$", ""))
    leading = [*QUESTION_WORDS, *AUXILIARIES, "in", "on", "of", "at", "the", "a"]

    def mark(w: Column, i: Column) -> Column:
        named = w.rlike(r"^\p{Lu}") & ~((i == 0) & F.lower(w).isin(leading))
        return F.when(named, NAME).when(w.rlike(r"^\p{N}+$"), "#").otherwise(F.lower(w))

    joined = F.array_join(F.transform(plain, mark), " ")
    return F.concat(F.lit(" "), F.regexp_replace(joined, f"{NAME}(?: {NAME}| #)+", NAME), F.lit(" "))


def _one(words) -> str:
    return f"(?:{'|'.join(words)})"


def _opens(line: Column, *words: str) -> Column:
    return line.rlike(f"^ {_one(words)} ")


def _holds(line: Column, words) -> Column:
    return line.rlike(f" {_one(words)} ")


def _pairs_names(line: Column, *links: str) -> Column:
    """Two names with one of the words between them, an article allowed."""
    return line.rlike(f" {NAME} {_one(links)} (?:(?:the|a|an) )?{NAME} ")


def describes(line: Column) -> Column:
    """A person told by a work: the director of ..., whose author ..., a name's founder, has the writer who ..."""
    holder = f"{_one(HOLDERS)}s?"
    return line.rlike(f" {holder} (?:of|for) | (?:whose|{NAME}|(?:has|have|had) the) {holder} ")


def shape(line: Column) -> Column:
    """The structure of a line of marks."""
    likened = line.rlike(r" same (?:\S+ ){0,4}as ")
    choice = _pairs_names(line, "or", "versus", "vs")
    listing = _pairs_names(line, "and")
    weighs = _holds(line, COMPARED)
    shares = _holds(line, SHARED) & ~likened
    asks = _opens(line, *QUESTION_WORDS, *AUXILIARIES)
    compares = asks & (choice | (listing & (shares | (weighs & ~likened & _opens(line, *AUXILIARIES, "which", "who")))))
    narrowed = line.rlike(r"^ \S+ (?:.* )?(?:whose|that|which|who|whom|where) ")
    each = listing & _opens(line, "when", "where", "what", "which", "how", "in", "on") & ~narrowed
    return (
        F.when(compares & describes(line), "bridge_comparison").when(compares, "parallel_comparison")
        .when(each, "parallel_attribute").otherwise("chain_or_unknown")
    )


def routed(found: Column, described: Column, hops: Column) -> Column:
    """found: the structure; described: whether a person is told by a work."""
    chain = found == "chain_or_unknown"
    return F.when(chain & (hops >= 3), "dependency_chain").when(chain & described, "nested_bridge").otherwise(found)


def _of(question: Column, rule) -> Column:
    """A rule of the question's line, which a lambda holds so that it is not made again for each pattern."""
    return F.get(F.transform(F.array(marks(question)), rule), F.lit(0))


def structure(question: Column) -> Column:
    """parallel_comparison: names are held against each other. bridge_comparison: what is compared hangs on another
    relation of each name. parallel_attribute: one attribute is asked of each name. Else chain_or_unknown."""
    return _of(question, shape)


def route(question: Column, hops: Column) -> Column:
    """The structure, except that deep questions are dependency chains and chains through a description nested bridges."""
    return _of(question, lambda line: routed(shape(line), describes(line), hops))
