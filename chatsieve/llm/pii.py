"""Personal data: patterns propose, checksums confirm, context adjusts.

Everything is a row-local expression, so one scan does the work and no row is
ever shuffled.  Java gives the matches (``regexp_extract_all``) and the pieces
between them (``split``) but not their positions; these are running totals of
the lengths of pieces and matches.  Totals are taken in blocks of 256, so a
text with 500,000 addresses costs no square of that.

The proposals are the given patterns in a form whose cost is linear in the
text: a match starts only where a run starts (or where the last match ended,
``\\G``), and loops are possessive.  Neither changes which spans are found.

Added kinds (all need more than their pattern): ``iban`` has its country's
length, so the next word never belongs to it, and needs mod 97 = 1,
``ssn`` and ``secret`` need a context word in the 40 characters before (of the
text, so earlier matches do not end it).

Defined results: null text counts as empty; repeated rows are judged one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import id_and_text

# Kinds in the order that breaks ties, the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE_KINDS = 4

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """IBANs of each country's own length, in one run or in groups of four; other countries by form alone."""
    forms = []
    for size, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(size - 4, 4)
        tail = rf"\x20[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}"
                     rf"(?:[A-Z0-9]{{{size - 4}}}|(?:\x20[A-Z0-9]{{4}}){{{groups}}}{tail})")
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    forms.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}+|(?:\x20[A-Z0-9]{{4}}){{2,7}}+(?:\x20[A-Z0-9]{{1,3}})?+)")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # A whole run of digits, single spaces and hyphens between them, of 14 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
}
# Cheap conditions without which a pattern cannot match.
NEEDS = {"email": ["@"], "ip": ["."], "phone": ["+"], "ssn": ["-"]}
CONTEXT = {
    "email": "mail|contact|write to|schreib|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"phone|\bcall\b|\btel|mobile|fax|telefon|llam",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "secret": r"token|secret|passw|api.?key|credential",
}
# Score of a confirmed span without and with a context word before it.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95),
          "iban": (0.85, 1.0), "ssn": (0.3, 0.8), "secret": (0.2, 0.9)}
CONTEXT_CHARS = 40
# Least characters of a match: so many matches back the context can reach.
SHORTEST = {"email": 5, "ip": 7, "card": 14, "phone": 4, "iban": 14, "ssn": 11, "secret": 20}
BLOCK = 256


def _exclusive_totals(lengths: Column) -> Column:
    """Sums of all earlier elements, one for each element."""
    def scan(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, scan(sums), lambda b, first: F.transform(scan(b), lambda x: x + first)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    rev = F.reverse(digits)

    def step(total, i):
        d = F.substring(rev, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)
    return total % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN (spaces allowed)."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(step(a, ch))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # Parts of more than 9 digits that start with zeros may still be small numbers.
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(m, r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return luhn_ok(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97_ok(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


SPAN = "struct<start:bigint,kind:int,end:bigint,score:double>"


def _spans(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``s_<kind>``: the confirmed spans of one kind, in order."""
    pattern = PATTERNS[kind]
    possible = F.lit(True)
    for needle in NEEDS.get(kind, []):
        possible = possible & F.contains(F.col("text"), F.lit(needle))
    found = F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("m", F.coalesce(found, F.array().cast("array<string>")))
    some = F.size("m") > 0
    df = df.withColumn("g", F.when(some, F.split("text", pattern, -1)))
    df = df.withColumn("at", F.when(some, _exclusive_totals(F.zip_with(
        F.slice("g", F.lit(1), F.size("m")), F.col("m"),
        lambda gap, m: (F.length(gap) + F.length(m)).cast("long")))))
    no = KINDS.index(kind)
    plain, near = SCORES[kind]

    def before(gaps: Column, ends: Column) -> Column:
        """Length of the piece and the text of ``CONTEXT_CHARS`` characters before each match."""
        back = range(-(-CONTEXT_CHARS // SHORTEST[kind]), 0, -1)
        return F.transform(gaps, lambda gap, i: F.struct(
            F.length(gap).alias("gap"),
            F.right(F.concat_ws("", *[F.get(ends, i - j) for j in back], gap), F.lit(CONTEXT_CHARS)).alias("context")))

    def span(b_at: Column, m: Column) -> Column:
        start = b_at["at"] + b_at["b"]["gap"]
        hint = F.lower(b_at["b"]["context"]).rlike(CONTEXT[kind])
        score = F.when(hint, F.lit(near)).otherwise(F.lit(plain))
        return F.struct(start.alias("start"), F.lit(no).alias("kind"), (start + F.length(m)).alias("end"),
                        F.when(_valid(kind, m), score).otherwise(F.lit(0.0)).alias("score"))

    gaps = F.slice("g", F.lit(1), F.size("m"))
    ends = F.zip_with(gaps, F.col("m"), lambda gap, m: F.right(F.concat(gap, m), F.lit(CONTEXT_CHARS)))
    # The array of one binds the ends once, not once a match.
    pieces = F.transform(F.array(ends), lambda e: before(gaps, e))[0]
    pairs = F.zip_with(pieces, F.col("at"), lambda b, at: F.struct(b.alias("b"), at.alias("at")))
    spans = F.filter(F.zip_with(pairs, F.col("m"), span),
                     lambda s: s["score"] > (0.0 if no < BASE_KINDS else 0.5))
    return df.withColumn(f"s_{kind}", F.coalesce(F.when(some, spans), F.array().cast(f"array<{SPAN}>"))) \
        .drop("m", "g", "at")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the spans of each kind as arrays ``s_<kind>``."""
    df = id_and_text(docs, id_col, text_col)
    for kind in KINDS:
        df = _spans(df, kind)
    return df


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text."""
    df = find_personal_data(docs, id_col, text_col)
    base = F.concat(*[F.col(f"s_{k}") for k in KINDS[:BASE_KINDS]])
    every = F.concat(*[F.col(f"s_{k}") for k in KINDS])
    return df.select(
        "doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:BASE_KINDS]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
