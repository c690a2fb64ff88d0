"""Format-preserving pseudonyms of personal data, in DataFrame operations alone.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so equal
values get equal pseudonyms in all documents, different ones different ones, and length, separators
and check digits stay valid.  A text is split at the matches of one pattern and put together again
with each match replaced; nothing is shuffled.

Kinds, and what makes a match valid:
  card    13 to 19 digits, in one piece or in groups, with a right Luhn sum; the check digit is renewed
  phone   North American number with country or area code; area and number are permuted, +1 stays
  ssn     three, two and four digits of the ranges that are issued
  ip      four octets up to 255
  date    year-month-day, or day and month before the year, of an existing day of 1800 to 2199
  email   letters and digits of the local part, each within its kind; the domain stays
  secret  32 and more hexadecimal digits in quotes behind a name and an equals sign or colon

Defined cases: null stays null, an empty text empty; texts without matches stay as they are; equal
rows get equal results; matches that are not valid stay; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}",
    "secret": r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD)\s?[=:]\s?[\"'][0-9a-fA-F]{32,128}[\"']",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])\+1[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
HEX = "0123456789abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Days of 1800-01-01 to 2199-12-31: one cycle of the calendar, 189 * 773.
FIRST_DAY, DAY_PARTS = -62091, (189, 773)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one being the check digit."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x)


def _digits_of(c: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(c, "[^0-9]", "")), lambda x: x.cast("long"))


def _longs(*values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values])


def _numbers(values: Column, radix: Column, good: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.struct(F.when(good, values).otherwise(none).alias("v"), F.when(good, radix).otherwise(none).alias("r"), none.alias("f"))


def _by_char(m: Column, kind: Column, last: Column) -> Column:
    """The numbers of the characters that change: digits have radix 10, letters 26, hexadecimal digits 16.

    ``f`` has the radix of every character of the match, 1 for those that stay; separators are no part
    of the value, so one number in two layouts has one pseudonym.
    """
    chars = _chars(m)
    begin = F.when(kind == "secret", F.least(F.when(F.instr(m, '"') > 0, F.instr(m, '"')).otherwise(10**6), F.when(F.instr(m, "'") > 0, F.instr(m, "'")).otherwise(10**6)))
    begin = begin.when((kind == "phone") & m.startswith("+1"), F.lit(2)).otherwise(F.lit(0))
    end = F.when(kind == "email", F.instr(m, "@") - 1).when(kind == "secret", F.length(m) - 1).otherwise(last)
    hexa = kind == "secret"
    value = lambda c, i: F.when((i < begin) | (i >= end), 0).when(hexa, F.instr(F.lit(HEX), F.lower(c)) - 1).when(
        c.rlike("[0-9]"), F.instr(F.lit(HEX), c) - 1).when((kind == "email") & c.rlike("[A-Za-z]"), F.instr(F.lit(LETTERS), F.lower(c)) - 1).otherwise(0).cast("long")
    radix = lambda c, i: F.when((i < begin) | (i >= end), 1).when(hexa, 16).when(c.rlike("[0-9]"), 10).when(
        (kind == "email") & c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")
    live = F.filter(F.arrays_zip(F.transform(chars, value).alias("v"), F.transform(chars, radix).alias("r")), lambda e: e["r"] > 1)
    return F.struct(live["v"].alias("v"), live["r"].alias("r"), F.transform(chars, radix).alias("f"))


def _date_text(m: Column) -> Column:
    """The day as year-month-day; day before month where both orders are possible."""
    one, two, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    return F.when(m.rlike("^[0-9]{4}-"), m).when(two > "12", F.concat_ws("-", year, one, two)).otherwise(F.concat_ws("-", year, two, one))


def _day_number(m: Column) -> Column:
    return F.datediff(F.try_to_timestamp(_date_text(m), F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date")) - FIRST_DAY


def _opened(z: Column) -> Column:
    """The numbers of a match that are permuted, and their radices; empty if the match is not valid."""
    m, kind = z["m"], z["kind"]
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    ssn = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    a, b = DAY_PARTS
    day = _day_number(m)
    # the place of a card's check digit is its last character
    return (F.when(kind == "ip", _numbers(octets, F.transform(octets, lambda _: F.lit(256).cast("long")), F.forall(octets, lambda x: x < 256)))
            .when(kind == "ssn", _numbers(_longs(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1), _longs(898, 99, 9999), ssn))
            .when(kind == "date", _numbers(_longs(F.floor(day / b), day % b), _longs(a, b), F.coalesce((day >= 0) & (day < a * b), F.lit(False))))
            .when((kind == "card") & (_luhn(_digits_of(m)) % 10 != 0), _numbers(_longs(0), _longs(1), F.lit(False)))
            .otherwise(_by_char(m, kind, F.when(kind == "card", F.length(m) - 1).otherwise(F.length(m)))))


def _round(key: str, step: int):
    """One round on the halves a and b of a match: numbers that depend on one half are added to the other."""
    to, other = ("a", "b") if step % 2 == 0 else ("b", "a")

    def run(z: Column) -> Column:
        seed = F.concat_ws("|", F.lit(f"{key}|{step}"), z["kind"], F.array_join(F.transform(z[other], lambda x: x.cast("string")), ","))
        stream = F.concat(F.sha2(F.concat(F.lit("0|"), seed), 512), F.sha2(F.concat(F.lit("1|"), seed), 512))  # 64 numbers of 16 bits
        moved = F.transform(F.arrays_zip(z[to].alias("x"), z["r" + to].alias("r")),
                            lambda e, i: (e["x"] + F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("long")) % e["r"])
        return F.struct(z["m"].alias("m"), z["kind"].alias("kind"), *[(moved if n == to else z[n]).alias(n) for n in ("a", "b")], z["ra"].alias("ra"), z["rb"].alias("rb"), z["f"].alias("f"))

    return run


def _closed(z: Column) -> Column:
    """The pseudonym of a match from its permuted numbers."""
    m, kind, v, f = z["m"], z["kind"], z["v"], z["f"]
    upper = m.rlike("[A-F]{1,}[0-9A-F]*[\"']$")
    at = F.transform(f, lambda r, i: F.struct(r.alias("r"), F.when(r > 1, F.element_at(v, F.greatest(F.lit(1), F.size(F.filter(F.slice(f, F.lit(1), i + 1), lambda x: x > 1))))).alias("v")))
    hexa = lambda e: F.substring(F.lit(HEX), (e["v"] + 1).cast("int"), F.lit(1))
    letter = lambda e: F.substring(F.lit(LETTERS), (e["v"] + 1).cast("int"), F.lit(1))
    chars = F.zip_with(_chars(m), at, lambda c, e: F.when(e["r"] == 1, c).when(e["r"] == 10, e["v"].cast("string"))
                       .when(e["r"] == 16, F.when(upper, F.upper(hexa(e))).otherwise(hexa(e))).when(c.rlike("[A-Z]"), F.upper(letter(e))).otherwise(letter(e)))
    text = F.array_join(chars, "")
    zeroed = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("0"))
    card = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), ((10 - _luhn(_digits_of(zeroed)) % 10) % 10).cast("string"))
    area = F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1)
    day = F.date_add(F.lit("1970-01-01").cast("date"), (v[0] * DAY_PARTS[1] + v[1] + FIRST_DAY).cast("int"))
    mark, mid = F.substring(m, 3, 1), F.substring(m, 4, 2)
    date = (F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd"))
            .when(mid > "12", F.concat(F.date_format(day, "MM"), mark, F.date_format(day, "dd"), mark, F.date_format(day, "yyyy")))
            .otherwise(F.concat(F.date_format(day, "dd"), mark, F.date_format(day, "MM"), mark, F.date_format(day, "yyyy"))))
    return (F.when(F.size(v) == 0, m).when(kind == "card", card).when(kind == "ip", F.array_join(F.transform(v, lambda x: x.cast("string")), "."))
            .when(kind == "ssn", F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0")))
            .when(kind == "date", date).otherwise(text))


def kind_of(m: Column) -> Column:
    out = F.when(m.contains("@"), F.lit("email"))
    for kind in KINDS[1:]:
        out = out.when(m.rlike("^(?:" + PATTERNS[kind].replace("(?<![0-9.])", "").replace("(?<![0-9-])", "").replace("(?<![0-9])", "") + ")$"), F.lit(kind))
    return out


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced, and ``pii``: (kind, count) of what was replaced, by kind.

    The matches of a text are an array that passes through one projection per round.
    """
    text = docs[text_col]
    none = F.array().cast("array<string>")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(none)
    work = docs.withColumn("__m", F.coalesce(found, none))
    work = work.withColumn("__z", F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    work = work.withColumn("__z", F.transform("__z", lambda z: F.struct(z["m"].alias("m"), z["kind"].alias("kind"), _opened(z).alias("o"))))

    def halves(z: Column) -> Column:
        v, r = z["o"]["v"], z["o"]["r"]
        cut = F.floor((F.size(v) + 1) / 2).cast("int")
        rest = F.greatest(F.size(v) - cut, F.lit(0))
        return F.struct(z["m"].alias("m"), z["kind"].alias("kind"), F.slice(v, F.lit(1), cut).alias("a"), F.slice(v, cut + 1, rest).alias("b"),
                        F.slice(r, F.lit(1), cut).alias("ra"), F.slice(r, cut + 1, rest).alias("rb"), z["o"]["f"].alias("f"))

    work = work.withColumn("__z", F.transform("__z", halves))
    for step in range(ROUNDS):
        work = work.withColumn("__z", F.transform("__z", _round(key, step)))
    work = work.withColumn("__z", F.transform("__z", lambda z: F.struct(z["m"].alias("m"), z["kind"].alias("kind"), F.concat(z["a"], z["b"]).alias("v"), z["f"].alias("f"))))
    work = work.withColumn("__z", F.transform("__z", lambda z: F.struct(z["m"].alias("m"), z["kind"].alias("kind"), _closed(z).alias("new"))))
    gaps = F.split(text, f"(?:{ANY})", -1)
    whole = F.array_join(F.zip_with(gaps, F.col("__z"), lambda g, z: F.concat(g, F.coalesce(z["new"], F.lit("")))), "")
    changed = F.filter("__z", lambda z: z["m"] != z["new"])
    counted = F.transform(F.array(*[F.lit(k) for k in sorted(KINDS)]), lambda k: F.struct(k.alias("kind"), F.size(F.filter(changed, lambda z: z["kind"] == k)).alias("n")))
    pii = F.filter(counted, lambda c: c["n"] > 0)
    return work.withColumns({text_col: F.when(F.size("__m") > 0, whole).otherwise(text),
                             "pii": F.when(F.size("__m") > 0, pii).otherwise(F.array().cast("array<struct<kind: string, n: int>>"))}).drop("__m", "__z")


def digest(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = pseudonymised(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key)
    return out.select("doc_id", "text", F.coalesce(F.aggregate("pii", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long")).alias("n_replaced"), F.to_json("pii").alias("kinds"))
