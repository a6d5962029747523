"""A grammar of relations as JVM expressions: what a question asks of which subject, and whether a sentence bears it out.

A relation has question forms, each with one group for the subject, and sentence forms, in which {S} stands for the subject
and {A} for the answer. Forms are regular expressions; subject and answer enter them quoted, so no form ever joins words of
two sentences; the forms are a small table that claims are joined with. The forms are this library's own, written for English source text.

A sentence supports a claim if a form of the relation matches it whole from subject to answer. It contradicts the claim if
- a form of a relation with a direction matches with subject and answer exchanged ("other_direction"),
- a form matches with another value where the relation has one value a subject: a date, a place, a count ("other_value"),
- the form matches, but the question's year lies outside the years that the sentence gives ("outside_interval").
A sentence with a negation says nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Relation:
    name: str
    questions: tuple[str, ...]
    sentences: tuple[str, ...]
    directed: bool = True  # exchanging subject and answer makes another claim
    value: str = ""  # pattern of the values, where a subject has only one


_DATE = r"(?:\d{1,2} [A-Z][a-z]+ |[A-Z][a-z]+ \d{1,2}, )?\d{4}"
_COUNT = r"(?:\d[\d,]*|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_NAME = r"[A-Z][\w'.-]*(?: (?:of |the |de |von )?[A-Z][\w'.-]*)*"
_BE, _HAVE = r"(?:is|was|are|were)", r"(?:has|had|have)"
_ROLE = r"(?:(?:an?|the|his|her|its) (?:[\w-]+ ){0,3}?)?"


def _made(name: str, verb: str, done: str, noun: str) -> Relation:
    """Someone who made a work: wrote, written, author."""
    return Relation(
        name,
        (rf"^who (?:{verb}) (.+)$", rf"^who {_BE} the (?:{noun}) of (.+)$", rf"^(?:by whom )?{_BE} (.+) (?:{done}) by whom$"),
        (rf"{{A}} (?:also |later |first )?(?:{verb}) {_ROLE}{{S}}", rf"{{S}}(?:,[^,]+,)? {_BE} (?:{done}) by {{A}}", rf"{{S}},? {_ROLE}[\w -]*?(?:{done}) by {{A}}", rf"{{A}}(?:,[^,]+,)? {_BE} the (?:{noun}) of {_ROLE}{{S}}", rf"the (?:{noun}) of {{S}} {_BE} {{A}}"),
    )


def _kin(name: str, noun: str, reverse: str) -> Relation:
    return Relation(
        name,
        (rf"^who {_BE} the (?:{noun}) of (.+)$", rf"^who {_BE} (.+?)['’]s (?:{noun})$"),
        (rf"{{A}}(?:,[^,]+,)? {_BE} the (?:{noun}) of {{S}}", rf"{{S}}['’]s (?:{noun})(?:,| {_BE}) {{A}}", rf"the (?:{noun}) of {{S}},? {_BE} {{A}}", rf"{{S}}(?:,[^,]+,)? {_BE} (?:a|the) (?:{reverse}) of {{A}}"),
    )


RELATIONS = (
    _made("author", "wrote|writes|authored", "written|authored", "author|writer"),
    _made("director", "directed|directs", "directed", "director"),
    _made("composer", "composed", "composed", "composer"),
    _made("producer", "produced|produces", "produced", "producer"),
    _made("publisher", "published|publishes", "published", "publisher"),
    _made("performer", "performed|performs|sang|recorded", "performed|sung|recorded", "performer|singer"),
    _made("founder", "founded|established", "founded|established", "founder"),
    _kin("mother", "mother", "son|daughter|child"),
    _kin("father", "father", "son|daughter|child"),
    Relation("spouse", (rf"^who {_BE} the (?:spouse|wife|husband) of (.+)$", rf"^who {_BE} (.+?)['’]s (?:spouse|wife|husband)$", r"^who did (.+?) marry$", rf"^who {_BE} (.+?) married to$"), (r"{S}(?:,[^,]+,)? married {A}", r"{A}(?:,[^,]+,)? married {S}", rf"{{S}} {_BE} married to {{A}}", rf"{{A}} {_BE} married to {{S}}", rf"{{A}} {_BE} the (?:wife|husband|spouse) of {{S}}", rf"{{S}}['’]s (?:wife|husband|spouse)(?:,| {_BE}) {{A}}"), False),
    Relation("birth_date", (rf"^(?:when|(?:in )?(?:what|which) year) {_BE} (.+) born$", rf"^what {_BE} the (?:birth date|date of birth|birth year) of (.+)$"), (rf"{{S}}(?:,[^,]+,)? {_BE} born (?:in [^,.]+, )?(?:on|in) {{A}}", rf"{{S}} \((?:born )?{{A}}"), False, _DATE),
    Relation("birth_place", (rf"^where {_BE} (.+) born$", rf"^(?:in )?(?:what|which) (?:city|country|town|place|state) {_BE} (.+) born(?: in)?$"), (rf"{{S}}(?:,[^,]+,)? {_BE} born (?:on [^,.]+?,? |in \d{{4}},? )?(?:in|at) {{A}}",), False, _NAME),
    Relation("death_date", (r"^(?:when|(?:in )?(?:what|which) year) did (.+) die$",), (r"{S}(?:,[^,]+,)? died (?:in [^,.]+, )?(?:on|in) {A}", r"{S} \([^)]*?[-–] ?{A}\)"), False, _DATE),
    Relation("capital", (rf"^(?:what|which city) {_BE} the capital (?:city )?of (.+)$",), (rf"{{A}}(?:,[^,]+,)? {_BE} the capital(?: city| and [\w ]+)? of {{S}}", rf"the capital(?: city)? of {{S}} {_BE} {{A}}", rf"{{S}}['’]s capital(?: city)?(?:,| {_BE}) {{A}}")),
    Relation("location", (rf"^where {_BE} (.+?)(?: located| situated)?$", rf"^(?:in )?(?:what|which) (?:region|country|city|continent|state|place) {_BE} (.+) (?:located|situated)(?: in)?$"), (rf"{{S}}(?:,[^,]+,)? {_BE} (?:an? [\w ]+ )?(?:located |situated )?(?:in|at) (?:the [\w ]+ of )?{{A}}",)),
    Relation("residence", (r"^where (?:does|did) (.+) live$",), (r"{S}(?:,[^,]+,)? (?:lives|lived|resides|resided) in {A}",), True, r"[\w' -]+"),
    Relation("broadcaster", (r"^(?:what|which) (?:network|channel|station) (?:broadcast|broadcasts|aired|airs|shows|showed) (.+)$", rf"^(?:on )?(?:what|which) (?:network|channel|station) {_BE} (.+?) (?:broadcast|aired|shown)(?: on)?$", r"^(?:on )?(?:what|which) (?:network|channel|station) (?:did|does) (.+?) air(?: on)?$"), (rf"{{S}}(?:,[^,]+,)? (?:{_BE} )?(?:broadcast|aired|airs|shown|premiered)(?: [\w ]+?)? (?:on|by) {{A}}", r"{A}(?:,[^,]+,)? (?:broadcast|broadcasts|aired|airs|showed) {S}")),
    Relation("album", (rf"^(?:on )?(?:what|which) album (?:{_BE} (.+)|does (.+) appear)(?: on)?$",), (rf"{{S}} {_BE} (?:a|the) (?:[\w-]+ )*?(?:song|track|single) (?:on|from) (?:the |his |her |their )?(?:[\w-]+ )*?(?:album )?{{A}}", r"{S} appears on (?:the |his |her |their )?(?:[\w-]+ )*?(?:album )?{A}", r"the album {A} (?:contains|includes|features) (?:the (?:song|track|single) )?{S}")),
    Relation("office", (rf"^who {_BE} (?:the )?((?:mayor|president|king|queen|governor|captain|chairman|leader|minister|bishop) of .+?)(?: in \d{{4}})?$",), (rf"{{A}}(?:,[^,]+,)? (?:{_BE}|served as|became) (?:the )?(?:[\w-]+ )?{{S}}", rf"the {{S}} {_BE} {{A}}")),
)
COUNTED = rf"^how many ([\w ]+?) (?:does|do|did) (.+?) have$"
INTERVAL = r"(?:from|between|since) (\d{4})(?: (?:to|until|till|and) (\d{4}))?"
NEGATION = r"(?i)\b(?:not|never|no longer|neither|nor|without|n't|denied|rumou?red)\b"
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def _plain(question: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(question), r"[?.!\s]+$", ""), r"\s+", " ")


def _quoted(value: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(F.trim(value), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def asks(question: Column) -> Column:
    """struct<relation, subject, thing, year> of a question: thing is what is counted; relation null where no form fits."""
    q = _plain(question)
    found = []
    for r in RELATIONS:
        for form in r.questions:
            groups = F.regexp_extract(q, "(?i)" + form, 1)
            if form.count("(") - form.count("(?:") > 1:
                groups = F.coalesce(F.nullif(groups, F.lit("")), F.regexp_extract(q, "(?i)" + form, 2))
            found.append(F.when(groups != "", F.struct(F.lit(r.name).alias("relation"), F.trim(groups).alias("subject"), F.lit(None).cast("string").alias("thing"))))
    thing = F.regexp_extract(q, "(?i)" + COUNTED, 1)
    found.insert(0, F.when(thing != "", F.struct(F.lit("count").alias("relation"), F.regexp_extract(q, "(?i)" + COUNTED, 2).alias("subject"), thing.alias("thing"))))
    best = F.coalesce(*found)
    year = F.nullif(F.regexp_extract(q, r"\b(?:in|during) (\d{4})$", 1), F.lit(""))
    return F.struct(best["relation"].alias("relation"), F.regexp_replace(best["subject"], r" (?:in|during) \d{4}$", "").alias("subject"), best["thing"].alias("thing"), year.cast("int").alias("year"))


def _number(value: Column) -> Column:
    word = F.lower(F.trim(value))
    out = F.regexp_replace(word, ",", "").try_cast("long")
    for i, name in enumerate(NUMBERS, 1):
        out = F.when(word == name, i).otherwise(out)
    return out


_SUBJECT, _ANSWER = "\x01", "\x02"


def forms(spark: SparkSession) -> DataFrame:
    """The table of sentence forms: relation, form, status and reason of a match. A few hundred rows."""
    rows = []
    for r in RELATIONS:
        for form in r.sentences:
            form = form.replace("{S}", _SUBJECT).replace("{A}", _ANSWER)
            rows.append((r.name, form, "supported", "form"))
            if r.directed:
                rows.append((r.name, form.translate({1: _ANSWER, 2: _SUBJECT}), "contradicted", "other_direction"))
            if r.value:
                rows.append((r.name, form.replace(_ANSWER, r.value), "contradicted", "other_value"))
    return spark.createDataFrame(rows, "relation string, form string, status string, reason string")


def check(claims: DataFrame) -> DataFrame:
    """claims: any columns with claim_id, question, answer and text. (claim_id, relation, subject, status, reason): the best a
    sentence of the text says, support before contradiction before nothing; a claim meets the forms of its relation only."""
    # A claim is judged in its own row; only the verdicts of rows with one id meet, which are one short row each.
    by_relation = forms(claims.sparkSession).groupBy("relation").agg(F.collect_list(F.struct("form", "status", "reason")).alias("forms"))
    spec = claims.withColumn("spec", asks(F.col("question"))).select("claim_id", "answer", "spec", F.split("text", r"(?<=[.!?;])\s+|\n+").alias("sentences"))
    each = spec.join(F.broadcast(by_relation), F.col("spec.relation") == F.col("relation"), "left")
    relation, subject = F.col("spec.relation"), _quoted(F.col("spec.subject"))
    verdict = lambda place, status, reason: F.struct(F.lit(place).alias("place"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    unknown = lambda reason: verdict(2, "unknown", reason)

    def fitting(sentence: Column, form: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)(?:^|[\s\"'(“])"), F.replace(F.replace(form["form"], F.lit(_SUBJECT), subject), F.lit(_ANSWER), _quoted(F.col("answer"))), F.lit(r"(?![\w])"))
        years = [F.regexp_extract(sentence, INTERVAL, i).try_cast("int") for i in (1, 2)]
        outside = F.col("spec.year").isNotNull() & years[0].isNotNull() & ((F.col("spec.year") < years[0]) | F.coalesce(F.col("spec.year") > years[1], F.lit(False)))
        stated = F.struct(F.when(form["status"] == "supported", 0).otherwise(1).alias("place"), form["status"].alias("status"), form["reason"].alias("reason"))
        matched = F.when(outside & (form["status"] == "supported"), verdict(1, "contradicted", "outside_interval")).otherwise(stated)
        return F.when(F.coalesce(F.rlike(sentence, pattern), F.lit(False)), matched).otherwise(unknown("no_form_fits"))

    def said(sentence: Column) -> Column:
        counted = F.concat(F.lit(r"(?i)(?:^|\s)"), subject, F.lit(rf"(?:,[^,]+,)? {_HAVE} (?:\w+ )?({_COUNT}) "), _quoted(F.col("spec.thing")))
        number = _number(F.call_function("regexp_extract", sentence, counted, F.lit(1)))
        count = F.when(number == _number(F.col("answer")), verdict(0, "supported", "form")).otherwise(verdict(1, "contradicted", "other_value"))
        return (
            F.when(F.rlike(sentence, F.lit(NEGATION)), unknown("negated")).when(relation.isNull(), unknown("relation_not_known"))
            .when((relation == "count") & number.isNotNull(), count)
            .otherwise(F.coalesce(F.array_min(F.transform("forms", lambda f: fitting(sentence, f))), unknown("no_form_fits")))
        )

    judged = each.select("claim_id", "spec", F.array_min(F.transform("sentences", said)).alias("v")).where("v IS NOT NULL")
    rows = judged.select("claim_id", F.struct("v.place", "v.status", "v.reason", "spec.relation", "spec.subject").alias("v"))
    best = rows.repartition("claim_id").groupBy("claim_id").agg(F.min("v").alias("b"))
    return best.select("claim_id", "b.relation", "b.subject", "b.status", "b.reason")
