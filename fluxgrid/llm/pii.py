"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Values found by pattern and validated (check digit and issuer, calendar, octets, groups) are permuted by a keyed
Feistel network within their format: digits stay digits, letters stay letters in their case, separators stay.
A permutation depends on the key, the kind and the value only, so equal values stay linked across documents
and different values stay apart.

Kinds: mail (letters of Latin-1 and Cyrillic are permuted, others stay), phone (with a plus, or national in the
North American, French and German forms), card (13 to 19 digits, undivided or in groups of 4-4-4-4, 4-4-4-4-3,
4-6-5 or 4-6-4 with one blank or hyphen between, that begin as an issuer's numbers do and end in the check digit;
the first four stay, the last is the new check digit), ip (four octets below 256, or the eight groups of version 6),
date (year-month-day or day.month.year that exist), secret (hexadecimal tokens of 32 digits and more, and access
keys with a known beginning).  Other runs of digits, such as order numbers, time stamps and book numbers, stay.

Cases: a null text stays null; an empty one stays empty; very long texts are treated whole; texts without
digits and at signs pass unread by the patterns; values that fail validation stay; repeated rows get equal
results; other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.common import let

EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
GROUPED = "|".join(
    f"[0-9]{{4}}{sep}(?:[0-9]{{4}}{sep}[0-9]{{4}}{sep}[0-9]{{4}}(?:{sep}[0-9]{{3}})?|[0-9]{{6}}{sep}[0-9]{{4,5}})" for sep in " -"
)
#: How card numbers begin, by the public ranges of issuers.
ISSUER = "^(?:4|5[0-9]|6[0-9]|3[04-9]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))"
#: National numbers: area code and seven digits; 0x and four pairs; an area code after 0, a bar or blank, digits.
NATIONAL = (
    r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-.])[2-9][0-9]{2}[-.][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[/ ][0-9]{5,8}"
)
GROUP = "[0-9A-Fa-f]{1,4}"
SIX = f"(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}}"
#: Beginnings of access keys whose format is public.
TOKENS = "(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk-[0-9A-Za-z_-]{20,}"
KINDS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,125}\.[A-Za-z]{2,63}" + END,
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}" + END
    + r"|(?<![\p{L}\p{N}.-])" + f"(?:{NATIONAL})" + END + r"(?![.-][0-9])",
    "ip": EDGE + r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + END + r"(?!\.[0-9])|(?<![\p{L}\p{N}:])" + f"(?:{SIX})" + r"(?![\p{L}\p{N}:])",
    "date": EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + END,
    "secret": EDGE + f"(?:[0-9A-Fa-f]{{32,}}|{TOKENS})" + END,
    "card": EDGE + f"(?:[0-9]{{13,19}}|{GROUPED})" + END,
}
PATTERN = "|".join(KINDS.values())
ROUNDS = 8
#: A longer half enters the network's noise by its digest, or the work would grow with the square of its length.
LONG = 1024
#: Days of one block of dates, as 200 by 365.
YEARS, DAYS = 200, 365


def noise(*parts: Column) -> Column:
    """48-bit number of a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


#: Letters outside ASCII that are permuted: first capital, first small letter, how many.
ALPHABETS = (("À", "à", 23), ("Ø", "ø", 7), ("А", "а", 32))


def moved(c: Column, by: Column, letters: int) -> Column:
    """A character moved within its class: ten digits, or the first ``letters`` letters of its case."""

    def turn(first: str, n: int) -> Column:
        return F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(n)))

    def turned(first: str, n: int) -> Column:
        letters_of = F.lit("".join(chr(ord(first) + k) for k in range(n)))
        return F.substring(letters_of, F.pmod(F.instr(letters_of, c) - 1 + by, F.lit(n)).cast("int") + 1, F.lit(1))

    last = chr(ord("a") + letters - 1)
    out = (
        F.when(c.between("0", "9"), turn("0", 10))
        .when(c.between("a", last), turn("a", letters))
        .when(c.between("A", last.upper()), turn("A", letters))
    )
    for capital, small, n in ALPHABETS:
        for first in (capital, small):
            out = out.when(c.between(first, chr(ord(first) + n - 1)), turned(first, n))
    return out.otherwise(c)


def permuted(value: Column, kind: str, key: Column, letters: int = 26) -> Column:
    """Feistel network over the two halves of a text; halves swap in each round."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b")
    )

    def turn(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        new = let(
            F.when(F.length(b) > LONG, F.sha2(F.lower(b), 256)).otherwise(F.lower(b)),
            lambda other: F.transform(
                F.split(a, ""), lambda c, i: moved(c, noise(key, F.lit(kind), r, F.length(a), i, other), letters)
            ),
        )
        return F.struct(b.alias("a"), F.array_join(new, "").alias("b"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"])
    )


def check_digit(body: Column) -> Column:
    """Luhn check digit of the digits before it."""
    n = F.length(body)
    parts = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: let(
            F.substring(body, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(parts, F.lit(0), lambda a, d: a + d), F.lit(10)), F.lit(10))


def placed(value: Column, digits: Column) -> Column:
    """New digits in the places of the digits of a value."""
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(
        F.transform(
            F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, place(i), F.lit(1))).otherwise(c)
        ),
        "",
    )


def bare(value: Column) -> Column:
    """The digits of a value."""
    return F.regexp_replace(value, "[^0-9]", "")


def valid_card(value: Column) -> Column:
    """Whether a number begins as an issuer's and ends in the check digit of the others; its groups don't matter."""
    return let(
        bare(value),
        lambda d: let(
            F.length(d),
            lambda n: d.rlike(ISSUER)
            & (check_digit(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1)).cast("int")),
        ),
    )


def card(value: Column, key: Column) -> Column:
    """The issuer's four digits stay, the others are permuted, the last is the check digit; an invalid number stays."""
    new = let(
        bare(value),
        lambda d: let(
            F.concat(F.substring(d, 1, 4), permuted(F.substring(d, F.lit(5), F.length(d) - 5), "card", key)),
            lambda body: placed(value, F.concat(body, check_digit(body).cast("string"))),
        ),
    )
    return F.when(valid_card(value), new).otherwise(value)


def phone(value: Column, key: Column) -> Column:
    """Country code, or area code and the digit after it, stay; the other digits are permuted whatever their groups."""
    head = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]|^0[1-9]|^\(?[2-9][0-9]{2}\)?[ .-]?[2-9]", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, placed(rest, permuted(bare(rest), "phone", key)))


def mixed(a: Column, b: Column, n: int, m: int, kind: str, key: Column) -> Column:
    """Feistel network over a pair of numbers below n and m; a struct of both."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        return let(
            F.pmod(acc["a"] + noise(key, F.lit(kind), r, F.lit("a"), acc["b"]), F.lit(n)).cast("long"),
            lambda x: F.struct(
                x.alias("a"), F.pmod(acc["b"] + noise(key, F.lit(kind), r, F.lit("b"), x), F.lit(m)).cast("long").alias("b")
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn)


def groups_fit(value: Column) -> Column:
    """Whether the octets of an address are below 256, or its groups are eight, or fewer around a double colon."""
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") < 256)
    groups = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
    short = (groups >= 3) | value.rlike("^(?i:fe80)::")
    six = F.when(value.contains("::"), (groups <= 7) & short & value.rlike("[0-9]")).otherwise(groups == 8)
    return F.when(value.contains(":"), six).otherwise(octets)


def address(value: Column, key: Column) -> Column:
    """Four octets as two 16-bit halves, or the digits of the groups; values that don't fit stay."""
    part = lambda k: F.split(value, r"\.")[k].cast("int")
    new = lambda v, shift: F.concat_ws(
        ".", F.floor(v[shift] / 256).cast("int").cast("string"), F.pmod(v[shift], F.lit(256)).cast("string")
    )
    pair = mixed(part(0) * 256 + part(1), part(2) * 256 + part(3), 1 << 16, 1 << 16, "ip", key)
    octets = let(pair, lambda v: F.concat_ws(".", new(v, "a"), new(v, "b")))
    six = permuted(value, "ip6", key, 6)
    return F.when(~groups_fit(value), value).when(value.contains(":"), six).otherwise(octets)


def day_number(value: Column) -> Column:
    """Days since 1900 of a written date; null if it doesn't exist."""
    iso = F.when(
        F.substring(value, 3, 1) == ".",
        F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)),
    ).otherwise(value)
    return F.datediff(iso.try_cast("date"), F.lit("1900-01-01").cast("date"))


def date(value: Column, key: Column) -> Column:
    """Days since 1900 permuted in blocks of 73,000 days; dates that don't exist stay."""
    german = F.substring(value, 3, 1) == "."
    day = day_number(value)
    block = F.floor(day / (YEARS * DAYS)).cast("long")
    inside = F.pmod(day, F.lit(YEARS * DAYS))
    pair = mixed(F.floor(inside / DAYS), F.pmod(inside, F.lit(DAYS)), YEARS, DAYS, "date", key)
    new = let(
        pair,
        lambda v: F.date_add(
            F.lit("1900-01-01").cast("date"), (block * (YEARS * DAYS) + v["a"] * DAYS + v["b"]).cast("int")
        ),
    )
    text = F.when(german, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd"))
    return F.when(day.isNull(), value).otherwise(text)


def is_kind(value: Column, kind: str) -> Column:
    """Whether the pattern of a kind covers a whole value."""
    return value.rlike(f"^(?:{KINDS[kind]})$")


def kind_of(value: Column) -> Column:
    """Kind under which one found value is replaced; null for a value that stays."""
    return (
        F.when(value.contains("@"), "mail")
        .when(is_kind(value, "phone"), "phone")
        .when(is_kind(value, "date"), F.when(day_number(value).isNotNull(), "date"))
        .when(is_kind(value, "ip"), F.when(groups_fit(value), "ip"))
        .when(is_kind(value, "secret"), "secret")
        .when(valid_card(value), "card")
    )


def secret(value: Column, key: Column) -> Column:
    """Hexadecimal digits stay such; an access key keeps its beginning."""
    head = F.regexp_extract(value, "^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk-)", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.when(head == "", permuted(value, "secret", key, 6)).otherwise(F.concat(head, permuted(rest, "secret", key)))


def pseudonym(value: Column, key: Column) -> Column:
    """Pseudonym of one found value."""
    tail = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    head = F.substring(value, F.lit(1), F.length(value) - F.length(tail))
    return (
        F.when(value.contains("@"), F.concat(permuted(head, "mail", key), tail))
        .when(is_kind(value, "phone"), phone(value, key))
        .when(is_kind(value, "date"), date(value, key))
        .when(is_kind(value, "ip"), address(value, key))
        .when(is_kind(value, "secret"), secret(value, key))
        .otherwise(card(value, key))
    )


def masked(text: Column, key: str) -> Column:
    """The text with its values replaced, as one expression."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    between = F.split(text, PATTERN, -1)
    new = let(
        F.struct(between.alias("between"), found.alias("found")),
        lambda v: F.array_join(
            F.zip_with(
                v["between"],
                F.transform(v["found"], lambda m: pseudonym(m, F.lit(key))),
                lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))),
            ),
            "",
        ),
    )
    return F.when(text.rlike("[0-9@]"), new).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns, the text with pseudonyms in place of personal data; who has the key can undo them."""
    return docs.withColumn(text_col, masked(F.col(f"`{text_col}`"), key))


def kinds(text: Column) -> Column:
    """Kinds of the values of a text that are replaced, one for each value."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), kind_of)
    none = F.array().cast("array<string>")
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda k: k.isNotNull())).otherwise(none)


def counts(found: Column) -> list[Column]:
    """Columns n_<kind>: how often each kind is among the kinds of a text."""
    return [F.size(F.filter(found, lambda x: x == k)).cast("long").alias(f"n_{k}") for k in KINDS]
