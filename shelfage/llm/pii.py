"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. For each kind the matches of its pattern are fenced with
a marker character, the text is split at the marker, and the lengths of the pieces give the
positions (code points, end exclusive); only piece lengths, matches and a few
characters around them are shuffled, never the texts. The patterns are
written with possessive quantifiers and a look-behind: they match what the plain
patterns in ``KINDS`` match, in linear time and without recursion on very long runs.

Base kinds: email, ip (parts up to 255), card (12 to 19 digits, Luhn), phone (9 to
15 digits). The method adds: iban (mod-97 of the rearranged digits equals 1) and
ssn (3-2-4 digits, valid ranges, and a context word near it, as no checksum exists).
Scores run from 0 to 1: a kind's base score, raised when a context word of the kind stands
within ``CONTEXT`` characters and lowered for values made of one repeated digit.

Defined cases: null text is empty; every row gives a row, also repeated ones and
null ids; an empty table gives an empty result; other columns are ignored; a marker character
in the text counts as another control character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "\u0001"
CONTEXT = 32

#: kind: (pattern, cheap test that a text can match, base score, context words)
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
              "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.7, "card|credit|visa|payment|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", None, 0.8, "iban|account|bank|konto|compte"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Remainder by 97 of an IBAN: first four characters moved to the end, letters as 10 to 35."""
    s = F.regexp_replace(match, r"\x20", "")
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    def step(acc, ch):
        v = F.ascii(ch)
        n = F.when(v >= 65, v - 55).otherwise(v - 48)
        return F.when(ch == "", acc).otherwise((acc * F.when(n >= 10, 100).otherwise(10) + n) % 97)
    return F.aggregate(turned, F.lit(0), step)


def _confirmed(kind: str, match: Column, near: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        # at most 255: leading zeros do not count
        return ~F.exists(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & \
            ~F.exists(F.split(match, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).try_cast("int") > 255)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)") & ~match.rlike("-00-|-0000$") & near.rlike(f"(?i)({KINDS['ssn'][3]})")
    return F.lit(True)


def _pieces(kind: str, text: Column) -> Column:
    """The text cut around the matches of a kind: odd places (from 0) are matches. Null if the kind cannot occur."""
    pattern, needs, _, _ = KINDS[kind]
    cut = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    rows = F.transform(
        F.sequence(F.lit(0), F.size(cut) - 1),
        lambda i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), F.length(F.get(cut, i)).cast("long").alias("len"),
            F.when(i % 2 == 1, F.get(cut, i)).alias("match"),
            F.when(i % 2 == 1, F.concat(F.right(F.get(cut, i - 1), F.lit(CONTEXT)), F.lit(" "),
                                        F.left(F.get(cut, i + 1), F.lit(CONTEXT)))).alias("near")))
    found = F.size(cut) > 1
    if needs:
        found = (F.instr(text, needs) > 0) & found
    return F.when(found, rows)


def spans(docs: DataFrame, kinds=tuple(KINDS)) -> DataFrame:
    """Confirmed spans, one row each: row (the document's row number), kind, start, end, match, score."""
    return _spans(_numbered(docs), kinds).where(F.col("ok")).select("row", "doc_id", "kind", "start", "end", "match", "score")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
                       F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, "\u0002").alias("text"))


def _spans(docs: DataFrame, kinds) -> DataFrame:
    """All proposed spans with ``ok`` set for confirmed ones; a document without any keeps one row of nulls."""
    none = F.array().cast("array<struct<kind:string,place:int,len:bigint,match:string,near:string>>")
    cut = docs.select("row", "doc_id", *[F.coalesce(_pieces(k, F.col("text")), none).alias(f"_{k}") for k in kinds])
    rows = cut.select("row", "doc_id", F.explode_outer(F.concat(*[F.col(f"_{k}") for k in kinds])).alias("p"))
    before = Window.partitionBy("row", "p.kind").orderBy("p.place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition("row").withColumn("start", F.coalesce(F.sum("p.len").over(before), F.lit(0)))
    rows = rows.select("row", "doc_id", "p.kind", "start", (F.col("start") + F.col("p.len")).alias("end"), "p.match", "p.near",
                       F.col("p").isNull().alias("none"))
    rows = rows.where(F.col("match").isNotNull() | F.col("none") | (F.col("start") == 0))
    pick = lambda f, other: reduce(lambda acc, k: F.when(F.col("kind") == k, f(k)).otherwise(acc), kinds, other)
    ok = F.col("match").isNotNull() & F.coalesce(pick(lambda k: _confirmed(k, F.col("match"), F.col("near")), F.lit(False)), F.lit(False))
    score = pick(lambda k: F.lit(KINDS[k][2]) + F.when(F.col("near").rlike(f"(?i)({KINDS[k][3]})"), 0.1 if k != "ssn" else 0.5).otherwise(0.0),
                 F.lit(0.0)) - F.when(_digits(F.col("match")).rlike(r"^([0-9])\1{7,}$"), 0.3).otherwise(0.0)
    return rows.withColumn("ok", ok).withColumn("score", F.when(F.col("ok"), F.round(score, 3)))


def report(docs: DataFrame, kinds=tuple(KINDS)) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans and their scores."""
    order = {k: i for i, k in enumerate(kinds)}
    found = _spans(_numbered(docs), kinds)
    rank = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    item = F.struct(F.col("start"), rank.alias("rank"), F.col("kind"), F.col("end"), F.col("score"))
    per_doc = found.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("ok") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in kinds],
        F.sort_array(F.collect_list(F.when(F.col("ok"), item))).alias("s"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(F.col("s"), lambda x: x["rank"] < len(BASE))
    return per_doc.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("s")).alias("spans"),
        *[f"n_{k}" for k in kinds if k not in BASE],
        F.array_join(F.transform(F.col("s"), lambda x: x["score"].cast("string")), ",").alias("scores"))
