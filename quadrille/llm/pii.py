"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is DataFrame functions. Positions of regex matches come from splitting a text by the same pattern: pieces and
matches alternate, so running lengths give the code points. Patterns use possessive forms that match what the stated ones
match, and cannot backtrack or recurse on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import text_of

#: Kinds in their order. The first four are the base and always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE = 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){14})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|password=[^\x20\x09-\x0D]++)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this character class has no match; a cheap test before the pattern runs.
NEEDS = {"email": "@", "phone": "+", "secret": None, "ip": None, "card": None, "iban": None, "ssn": None}
#: Words that raise the score of a kind when they stand within CONTEXT code points of the span, with no span of the same kind between.
CONTEXT_WORDS = {
    "email": "mail|email|e-mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|carte|tarjeta|karte",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "secret": "key|secret|token|aws|login|user",
    "ssn": "ssn|social|security|sozialversicherung",
}
CONTEXT = 40
#: Before context, and the least that a span beyond the base must reach: a number without checksum needs its context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "secret": 0.7, "ssn": 0.4}
RAISE, LEAST = 0.2, 0.6
#: Code points in a piece of a text that is cut up to be redacted.
PIECE = 512


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 (letters count 10 to 35)."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The checksum or range test of a kind."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def running(values: Column, step, zero: int = 0) -> Column:
    """The running aggregate of an array of numbers by ``step``. It goes block by block, of about the root of the size, so that no long array is copied for each entry."""
    none = F.array().cast("array<int>")
    block = F.ceil(F.sqrt(F.size(values))).cast("int")
    scan = lambda xs: F.aggregate(xs, F.struct(F.lit(zero).alias("at"), none.alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")), lambda acc: acc["out"])
    within = F.transform(F.sequence(F.lit(1), F.size(values), block), lambda i: scan(F.slice(values, i, block)))
    before = lambda w: F.concat(F.array(F.lit(zero)), scan(F.transform(w, lambda x: F.element_at(x, -1))))
    joined_ = F.transform(F.array(within), lambda w: F.flatten(F.zip_with(w, F.slice(before(w), 1, F.size(w)), lambda x, o: F.transform(x, lambda v: step(o, v)))))
    return F.when(F.size(values) > 0, F.element_at(joined_, 1)).otherwise(none)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (start, kind number, end, score)."""
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    nearby = rf"(?iu)(?<!\p{{L}})(?:{CONTEXT_WORDS[kind]})(?!\p{{L}})"

    def placed(matches: Column, pieces: Column) -> Column:
        n = F.size(matches)
        lengths = F.zip_with(matches, F.slice(pieces, 1, n), lambda m, p: F.length(m) + F.length(p))
        # What stands before and after a match are pieces, so nothing is sought from the start of the text.
        around = F.zip_with(F.slice(pieces, 1, n), F.slice(pieces, 2, n), lambda p, q: F.concat(F.right(p, F.lit(CONTEXT)), F.lit(" "), F.left(q, F.lit(CONTEXT))))
        each = F.arrays_zip(matches.alias("m"), running(lengths, lambda a, x: a + x).alias("e"), around.alias("near"))
        return F.filter(each, lambda x: confirmed(kind, x["m"]))

    found = bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), lambda x: placed(x["m"], x["p"]))
    scored = F.transform(found, lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), F.lit(number).alias("k"), x["e"].alias("e"), (F.lit(PRIOR[kind]) + F.when(x["near"].rlike(nearby), RAISE).otherwise(0.0)).alias("score")))
    held = scored if number < BASE else F.filter(scored, lambda x: x["score"] >= LEAST)
    none = F.array().cast("array<struct<s:int,k:int,e:int,score:double>>")
    maybe = text.rlike(pattern) if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
    return F.when(maybe, held.cast("array<struct<s:int,k:int,e:int,score:double>>")).otherwise(none)


def detect(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add ``findings``: every span as (s, k, e, score) by start, then kind; code points, end exclusive. Null texts count as empty and find nothing."""
    text = text_of(docs, column)
    found = docs.withColumns({f"__{k}": spans_of(text, k) for k in KINDS})
    return found.withColumn("findings", F.sort_array(F.flatten(F.array(*(F.col(f"__{k}") for k in KINDS))))).drop(*(f"__{k}" for k in KINDS))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def cut(pieces: Column, at: Column, to: Column) -> Column:
    """Code points ``at`` to ``to`` (exclusive) of a text in pieces of PIECE; the rest of the text is not walked."""
    first, last, rest = F.floor(at / PIECE).cast("int"), F.floor(to / PIECE).cast("int"), (to % PIECE).cast("int")
    inside = F.substring(F.get(pieces, first), (at % PIECE + 1).cast("int"), (to - at).cast("int"))
    tail = F.when(rest > 0, F.substring(F.get(pieces, last), F.lit(1), rest)).otherwise("")
    across = F.concat(F.substring(F.get(pieces, first), (at % PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    return F.when(at >= to, "").when(first == last, inside).otherwise(across)


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets, as in [EMAIL]; overlapping spans become one, named by the first. Other texts, nulls too, stay as they are."""
    text = docs[column]
    tag = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)), F.lit("]"))

    def replaced(spans: Column, reach: Column, pieces: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))  # where the spans before end
        parts = F.zip_with(spans, before, lambda x, at: F.when(x["s"] < at, "").otherwise(F.concat(cut(pieces, at, x["s"]), tag(x))))
        return F.concat(F.array_join(parts, ""), cut(pieces, F.element_at(reach, -1), F.length("__text")))

    found = detect(docs, column).withColumn("__text", text)
    reach = running(F.transform("findings", lambda x: x["e"]), lambda a, x: F.greatest(a, x))
    each = F.struct(reach.alias("r"), F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("p"))
    done = bound(each, lambda x: replaced(F.col("findings"), x["r"], x["p"]))
    return found.withColumn(column, F.when(F.size("findings") > 0, done).otherwise(F.col("__text"))).drop("__text")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per row: counts by base kind, the digest of the base spans, and all spans. Null and empty texts find nothing (the digest is that of no bytes); repeated rows repeat; other columns are not read."""
    found = detect(docs)
    base = F.filter("findings", lambda x: x["k"] < BASE)
    count = lambda k: F.size(F.filter("findings", lambda x: x["k"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:BASE]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents with redacted texts, in their own columns; n_chars becomes the new length where it was not null. Null and empty texts stay; repeated rows repeat; an empty table gives none."""
    columns = docs.columns
    done = redact(docs)
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)
