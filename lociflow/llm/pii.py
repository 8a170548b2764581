"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for bank accounts), and words nearby raise their score.
Base kinds (email, ip, card, phone) are kept whenever pattern and check hold, whatever their score. The method adds what reaches CUT:

- iban: country, two check digits and groups of four, by mod 97;
- card: sixteen digits in fours inside a longer run of digits that is no card as a whole, by Luhn and a word nearby;
- phone: seven to fifteen digits in groups without a plus before them, no date or address, by a word nearby.

Patterns run once over a text and give its matches and the pieces between; a match's place is the sum of the lengths before it. No
pattern reads a run of characters more than once or recurses: names begin where their run begins, or where the match before ended.
Sums are taken in blocks of BLOCK matches, so that a text of n matches costs n plus (n / BLOCK) squared steps. All of a text stays in
its row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: The base patterns, written so that they take time in proportion to the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of the kinds that are added; a run of letters and digits on either side rejects a match.
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
INSIDE = r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"
NATIONAL = r"\(?[0-9]{2,5}\)?[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}"
#: Kinds in the order of results, and the words that raise a score.
KINDS = ("email", "ip", "card", "phone", "iban")
WORDS = {"email": "e-?mail|mail|contact", "ip": "ip|address|host|server", "card": "card|visa|mastercard|amex|credit|payment", "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|transfer"}
#: Hundredths: of a pattern, of a checksum that holds, of a word nearby; what an added span needs.
PATTERN, CHECKED, NEAR, CUT = {"email": 80, "ip": 60, "card": 30, "phone": 60, "iban": 30, "inside": 20, "national": 30}, 40, 40, 70
#: Characters that are looked at for words on either side, as far as the next match of the pattern; matches summed at once.
WINDOW, BLOCK = 40, 1024
_MATCH = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
SPANS = "array<struct<kind:string,start:int,stop:int,score:double,base:boolean,value:string>>"


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is evaluated once, however often `then` or functions in it use it."""
    return F.transform(F.array(x), then)[0]


def matches(text: Column, pattern: str) -> Column:
    """Every match, leftmost first: start and stop in code points, its text, and up to WINDOW characters on either side."""
    last = lambda xs: F.element_at(xs, -1)
    total = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + x["size"])
    ends = lambda block, at: F.aggregate(block, F.array(at), lambda s, x: F.concat(s, F.array(last(s) + x["gap"] + x["size"])))
    place = lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("stop"), x["value"], x["before"], x["after"])
    around = lambda x: F.struct(F.length(x["a"]).alias("gap"), F.length(x["m"]).alias("size"), x["m"].alias("value"), F.substring(x["a"], -WINDOW, WINDOW).alias("before"), F.substring(x["b"], 1, WINDOW).alias("after"))

    def zipped(x: Column) -> Column:
        n = F.size(x["m"])
        return F.transform(F.arrays_zip(F.slice(x["p"], F.lit(1), n).alias("a"), x["m"].alias("m"), F.slice(x["p"], F.lit(2), n).alias("b")), around)

    def blocks(each: Column) -> Column:
        n = F.ceil(F.size(each) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(each, (i - 1) * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())

    def placed(parts: Column) -> Column:
        offsets = F.slice(F.aggregate(parts, F.array(F.lit(0)), lambda s, block: F.concat(s, F.array(last(s) + total(block)))), F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, offsets, lambda block, at: F.zip_with(block, F.slice(ends(block, at), F.lit(2), F.size(block)), place)))

    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return _once(_once(_once(found, zipped), blocks), placed).cast(_MATCH)


def luhn(digits: Column) -> Column:
    """Of at most 19 digits, whether their Luhn sum ends in 0."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 20):
        total = total + F.substring(padded if i % 2 else doubled, i, 1).cast("int")
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 by 97, its first four characters last, letters as 10 to 35."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    turned = F.split(F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4)), "")
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda r, c: F.when(value(c) > 9, r * 100 + value(c)).otherwise(r * 10 + value(c)) % 97)
    return rest == 1


def _digits(value: Column) -> Column:
    return F.translate(value, " ().-+", "")


def _near(kind: str, m: Column) -> Column:
    around = F.translate(F.concat(m["before"], F.lit("\n"), m["after"]), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return around.rlike(f"(^|[^a-z])({WORDS[kind]})([^a-z]|$)")


def _alone(m: Column) -> Column:
    """No letter or digit touches the match."""
    return ~m["before"].rlike("[A-Za-z0-9]$") & ~m["after"].rlike("^[A-Za-z0-9]")


def _span(kind: str, m: Column, pattern: str, checked: bool, base: bool, start: Column | None = None, value: Column | None = None) -> Column:
    score = F.least(F.lit(PATTERN[pattern] + CHECKED * checked) + F.when(_near(kind, m), NEAR).otherwise(0), F.lit(100))
    value = m["value"] if value is None else value
    start = m["start"] if start is None else start
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), (score / 100).alias("score"), F.lit(base).alias("base"), value.alias("value"))


#: Four parts of at most 255 each, with any zeros before.
PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: What a national number is not: an address, a date.
NO_NUMBER = r"^(?:[0-9]+(?:\.[0-9]+){3}|[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-][0-9]{4})$"
#: Before a national number: the beginning of a longer one.
LONGER = r"\+[\x20().0-9-]*$|[.-]$"


def _is_card(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19))


def find(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """All rows and columns, and `out_col`: an array of {kind, start, stop, score, base, value}, by kind in the order of KINDS, then start.

    Places are code points, the end exclusive; the score is from 0 to 1. A null or empty text has an empty array; rows that repeat are
    judged each. A column of the name `out_col` is replaced, and others of any name stay. Spans of different kinds may overlap.
    """
    names, taken = [], {c.lower() for c in df.columns}
    for name in ("_text", "_email", "_ip", "_card", "_phone", "_iban", "_national"):
        while name in taken:
            name = "_" + name
        names.append(name)
    text, *found = names
    t = F.col(text)
    has = lambda p: t.rlike(p)
    none = F.array().cast(_MATCH)
    out = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    guards = (F.contains(t, F.lit("@")), has(r"[0-9]\.[0-9]"), has(r"[0-9]"), F.contains(t, F.lit("+")), has(r"[A-Z]{2}[0-9]{2}"), has(r"[0-9]\)?[\x20.-][0-9]"))
    out = out.withColumns({c: F.when(g, matches(t, p)).otherwise(none) for c, g, p in zip(found, guards, (EMAIL, IP, CARD, PHONE, IBAN, NATIONAL))})
    email, ip, card, phone, iban, national = (F.col(c) for c in found)
    base = lambda xs, kind, ok, checked=False: F.transform(F.filter(xs, ok), lambda m: _span(kind, m, kind, checked, True))
    n_digits = lambda m: F.length(_digits(m["value"]))

    inside = lambda m: F.regexp_substr(m["value"], F.lit(INSIDE))
    place = lambda m: m["start"] + F.regexp_instr(m["value"], F.lit(INSIDE)) - 1
    runs = F.filter(card, lambda m: (n_digits(m) > 16) & ~_is_card(m["value"]) & F.coalesce(luhn(_digits(inside(m))), F.lit(False)))
    more_cards = F.transform(runs, lambda m: _span("card", m, "inside", True, False, place(m), inside(m)))
    plain = F.filter(national, lambda m: _alone(m) & ~m["before"].rlike(LONGER) & ~m["value"].rlike(NO_NUMBER) & n_digits(m).between(7, 15))
    more_phones = F.transform(plain, lambda m: _span("phone", m, "national", False, False))
    accounts = F.filter(iban, lambda m: _alone(m) & mod97(F.translate(m["value"], " ", "")))
    more_accounts = F.transform(accounts, lambda m: _span("iban", m, "iban", True, False))

    enough = lambda xs: F.filter(xs, lambda s: s["score"] * 100 >= CUT)
    in_order = lambda xs: F.array_sort(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s.alias("s"))))
    kinds = [
        base(email, "email", lambda m: F.lit(True)),
        base(ip, "ip", lambda m: m["value"].rlike(PARTS)),
        F.concat(base(card, "card", lambda m: _is_card(m["value"]), True), enough(more_cards)),
        F.concat(base(phone, "phone", lambda m: n_digits(m).between(9, 15)), enough(more_phones)),
        enough(more_accounts),
    ]
    spans = F.concat(*(F.transform(in_order(k.cast(SPANS)), lambda x: x["s"]) for k in kinds))
    return out.withColumn(out_col, spans).drop(*names)


def spans_text(spans: Column) -> Column:
    """kind:start:stop of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
