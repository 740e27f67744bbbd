"""Personal data replaced by format-preserving pseudonyms, in DataFrame operations only.

Found values are validated (check digits, ranges, calendar) and permuted within their format
by keyed Feistel networks.  Numbers: the integers of a format are written as p * q, and the two
places are shifted in turn by a keyed hash of the other, so every result lies in the format, at
once and for every size.  Cards stay valid by Luhn's rule, IBANs by their remainder, addresses
stay addresses, dates stay dates.  Strings (mailboxes, domains, account letters, secrets): the two
halves are shifted in turn, each character within its kind (digits, small letters, capitals, or
its block of 64 code points beyond ASCII); other characters stay where they are.  Both are
permutations: under one key equal values get equal pseudonyms and different values different
ones, so they stay linked across documents.  A permutation may map a value to itself; such a
value counts as not replaced.  Characters beyond 16 bits stay as they are.

Only matches are touched: the rest of a text is kept to the letter.  Null texts stay null,
empty ones empty, an empty table gives an empty result.  Rows are rewritten one by one, so
repeated rows and ids and ties do not matter.  Every pattern starts at the border of a run and
backtracks at most once over it, and values have no greatest length, so long texts and values
take linear time.  Extra columns pass through; an earlier column named pii is replaced.

The key is a parameter; whoever knows it can invert the pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters that one hash shifts.
BLOCK = 16

# the key word may end a longer name (client_secret, dbPassword) and stand in quotes; the whole run of the value is taken
_SECRET = r"(?i:(?:(?<![\p{L}\p{N}])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:token|(?:api|access|secret)[_-]?key|secret|password|passwd)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[A-Za-z0-9_+/=.\-]{8,}+)"
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}+"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
_DATE = r"(?<![\d/.\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/\-])"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![\d\p{L}])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d\p{L}])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)"
_CARD = r"(?<![\d\p{L}])\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}(?!\d)|(?<![\d\p{L}])3\d{3}[ \-]?\d{6}[ \-]?\d{5}(?!\d)"
ANY = "|".join((_SECRET, _EMAIL, _IP, _DATE, _SSN, _IBAN, _CARD, _PHONE))
#: A text without any of these holds no match.
HINT = r"[0-9@]|(?i:token|key|secret|passw)"

_FIRST, _DAYS = "1900-01-01", (4_297, 17)  # 1900 to 2099
_SSN_SIZE = (898 * 99, 9_999)


def _hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def permute(x: Column, p: Column | int, q: Column | int, tweak: str, key: str) -> Column:
    """A keyed permutation of the integers 0 to p * q - 1 (at most 10^18)."""
    p, q = (F.lit(n).cast("long") if isinstance(n, int) else n for n in (p, q))

    def shift(i: Column, half: str, by: Column) -> Column:
        return F.conv(F.substring(_hash(key, tweak, p, q, half, i, by), 1, 14), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        a = F.pmod(acc["a"] + shift(i, "a", acc["b"]), p)
        # a lambda's variable is computed once, where an expression would be anew for each use
        return F.transform(F.array(a), lambda v: F.struct(v.alias("a"), F.pmod(acc["b"] + shift(i, "b", v), q).alias("b")))[0]

    # integer division, as doubles do not hold all longs
    start = F.struct(F.call_function("div", x, q).alias("a"), F.pmod(x, q).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, lambda acc: acc["a"] * q + acc["b"])


def _shifted(c: Column, by: Column) -> Column:
    """A code point moved within its kind."""

    def within(first: int, size: int) -> Column:
        return F.pmod(c - first + by, F.lit(size)) + first

    kinds = F.when(c.between(48, 57), within(48, 10)).when(c.between(97, 122), within(97, 26)).when(c.between(65, 90), within(65, 26))
    beyond = c.between(0xC0, 0xFFFF) & ~c.between(0xD7C0, 0xDFFF) & ~c.between(0x2000, 0x2BFF) & ~c.between(0x3000, 0x303F)
    return kinds.when(beyond, F.call_function("div", c, F.lit(64)).cast("int") * 64 + F.pmod(c + by, F.lit(64))).otherwise(c)


def scrambled(s: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the strings of each layout: Feistel rounds over halves, every character moved within its kind."""

    def moved(a: Column, b: Column, i: Column) -> Column:
        seed = _hash(key, kind, i, F.array_join(b.cast("array<string>"), ","))
        blocks = F.sequence(F.lit(0), F.call_function("div", F.size(a), F.lit(BLOCK)).cast("int"))
        hashes = F.transform(F.array(seed), lambda x: F.transform(blocks, lambda k: _hash(x, k)))[0]
        return F.transform(F.array(hashes), lambda h: F.transform(a, lambda c, j: _shifted(c, F.conv(F.substring(h[F.call_function("div", j, F.lit(BLOCK)).cast("int")], F.pmod(j, F.lit(BLOCK)) * 4 + 1, F.lit(4)), 16, 10).cast("int"))))[0]

    def turn(acc: Column, i: Column) -> Column:
        return F.struct(acc["b"].alias("a"), moved(acc["a"], acc["b"], i).alias("b"))

    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))

    def permuted(c: Column) -> Column:
        half = F.call_function("div", F.size(c) + 1, F.lit(2)).cast("int")
        start = F.struct(F.slice(c, F.lit(1), half).alias("a"), F.slice(c, half + 1, F.size(c) - half).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))

    letter = lambda c: F.when(c < 128, F.char(c)).otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 4, F.lit("0"))), "UTF-16BE"))
    new = F.transform(F.array(codes), lambda c: permuted(c))[0]
    # code points beyond 16 bits are kept, and copied from the value
    joined = F.transform(F.array(new), lambda n: F.array_join(F.zip_with(n, F.split(s, ""), lambda c, old: F.when(c > 0xFFFF, old).otherwise(letter(F.least(c, F.lit(0xFFFF))))), ""))[0]
    return F.when(s == "", s).otherwise(joined)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(d: Column, odd_from_right: int) -> Column:
    """Luhn's sum of a digit string; ``odd_from_right`` 0 if the last digit counts once, 1 if it counts twice."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(F.pmod(i + odd_from_right, F.lit(2)) == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def refill(layout: Column, new: Column) -> Column:
    """``layout`` with its digits replaced, in order, by those of ``new``."""
    return F.array_join(F.transform(F.split(layout, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(new, F.length(digits(F.substring(layout, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def padded(x: Column, width: Column) -> Column:
    return F.lpad(x.cast("string"), width, F.lit("0"))


def _powers(n: Column) -> tuple[Column, Column]:
    """Two powers of ten whose product is 10^n."""
    low = F.call_function("div", n, F.lit(2)).cast("int")
    return tuple(F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long") for k in (n - low, low))


def card(m: Column, key: str) -> Column:
    body = F.substring(digits(m), F.lit(1), F.length(digits(m)) - 1)
    new = padded(permute(body.cast("long"), *_powers(F.length(body)), "card", key), F.length(body))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(new, 1), F.lit(10)), F.lit(10))
    return refill(m, F.concat(new, check.cast("string")))


def number(m: Column, kind: str, key: str, last: int) -> Column:
    """The last digits (at most ``last``) permuted, the others and the layout kept."""
    d = digits(m)
    n = F.least(F.length(d), F.lit(last))
    tail = F.substring(d, F.length(d) - n + 1, n)
    new = padded(permute(tail.cast("long"), *_powers(n), kind, key), n)
    return refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - n), new))


def address(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    x = permute(F.aggregate(o, F.expr("0L"), lambda a, b: a * 256 + b), 1 << 16, 1 << 16, "ip", key)
    return F.concat_ws(".", *[F.call_function("div", F.pmod(x, F.lit(256 ** (i + 1))), F.lit(256**i)).cast("string") for i in (3, 2, 1, 0)])


def date_of(m: Column) -> Column:
    """The date a match stands for; null if it's none between 1900 and 2099.  ``x/y/z`` is month first where that is a date."""
    d = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "dd.MM.yyyy"))
    return F.when(m.rlike(f"^(?:{_DATE})$") & d.between(F.lit(_FIRST).cast("date"), F.lit("2099-12-31").cast("date")), d)


def date(m: Column, key: str) -> Column:
    x = permute(F.datediff(date_of(m), F.lit(_FIRST).cast("date")).cast("long"), *_DAYS, "date", key)
    d = F.date_add(F.lit(_FIRST).cast("date"), x.cast("int"))
    form = F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("."), F.date_format(d, "dd.MM.yyyy"))
    return form.when(F.try_to_date(m, "MM/dd/yyyy").isNotNull(), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))


def ssn(m: Column, key: str) -> Column:
    a, g, s = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    area = a - F.when(a > 666, 2).otherwise(1)
    x = permute((area * 99 + g - 1) * 9_999 + s - 1, *_SSN_SIZE, "ssn", key)
    area = F.call_function("div", x, F.lit(99 * 9_999))
    area = area + F.when(area >= 665, 2).otherwise(1)
    group = F.pmod(F.call_function("div", x, F.lit(9_999)), F.lit(99)) + 1
    return F.concat_ws("-", padded(area, F.lit(3)), padded(group, F.lit(2)), padded(F.pmod(x, F.lit(9_999)) + 1, F.lit(4)))


def is_ssn(m: Column) -> Column:
    return m.rlike(f"^(?:{_SSN})$") & ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")


def _mod97(s: Column) -> Column:
    """Remainder modulo 97 of a string of digits and capital letters (A = 10 to Z = 35)."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[A-Z]"), a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48), F.lit(97)))


def is_iban(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    return m.rlike(f"^(?:{_IBAN})$") & F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def iban(m: Column, key: str) -> Column:
    """The account, letters and digits, is permuted and the check digits computed anew."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    account = scrambled(F.substring(s, F.lit(5), F.length(s)), "iban", key)

    def whole(account: Column) -> Column:
        check = padded(F.lit(98) - _mod97(F.concat(account, F.substring(s, 1, 2), F.lit("00"))), F.lit(2))
        return F.concat(F.substring(s, 1, 2), check, account)

    def laid_out(new: Column) -> Column:
        return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")

    return F.transform(F.transform(F.array(account), whole), laid_out)[0]


def email(m: Column, key: str) -> Column:
    """Mailbox and domain (whose capitals do not count) permuted; the result lies under a domain reserved for examples."""
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.lower(F.split_part(m, F.lit("@"), F.lit(2)))
    return F.concat(scrambled(local, "mailbox", key), F.lit("@"), scrambled(domain, "domain", key), F.lit(".example"))


def secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^[^=:]+[=:][ \t]*[\"']?", 0)
    return F.concat(name, scrambled(F.substring(m, F.length(name) + 1, F.length(m)), "secret", key))


def is_card(m: Column) -> Column:
    d = digits(m)
    return m.rlike(r"^[0-9][0-9 \-]+$") & F.length(d).between(13, 19) & (F.pmod(luhn_sum(d, 0), F.lit(10)) == 0) & ~d.rlike("^0+$")


def kind_of(m: Column) -> Column:
    """What a match is once validated; null if it's nothing."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(f"^(?:{_SECRET})"), "secret")
        .when(m.rlike(f"^(?:{_IP})$"), "ip")
        .when(date_of(m).isNotNull(), "date")
        .when(is_ssn(m), "ssn")
        .when(is_card(m), "card")
        .when(is_iban(m), "iban")
        .when(m.rlike(f"^(?:{_PHONE})$"), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", email(m, key))
        .when(kind == "secret", secret(m, key))
        .when(kind == "ip", address(m, key))
        .when(kind == "date", date(m, key))
        .when(kind == "ssn", ssn(m, key))
        .when(kind == "card", card(m, key))
        .when(kind == "iban", iban(m, key))
        .when(kind == "phone", number(m, "phone", key, 10))
        .otherwise(m)
    )


def found(text: Column, key: str) -> Column:
    """Matches of a text as an array of (value, kind, new)."""
    named = F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    return F.transform(named, lambda m: F.struct(m["value"].alias("value"), m["kind"].alias("kind"), pseudonym(m["value"], m["kind"], key).alias("new")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns, with the texts rewritten, and ``pii``: the kinds of the values that were replaced, in order (null text: null)."""
    if not key:
        raise ValueError("a key is needed")
    t = F.col(text_col)
    rows = docs.withColumn("pii", F.when(t.rlike(HINT), found(t, key)))
    new = F.concat(F.transform("pii", lambda m: m["new"]), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with(F.split(t, ANY, -1), new, lambda a, b: F.array(a, b))), "")
    rows = rows.withColumn(text_col, F.when(F.size("pii") > 0, whole).otherwise(t))
    kinds = F.transform(F.filter("pii", lambda m: m["new"] != m["value"]), lambda m: m["kind"])
    return rows.withColumn("pii", F.when(t.isNotNull(), F.coalesce(kinds, F.array().cast("array<string>"))))


def describe(docs: DataFrame, key: str) -> DataFrame:
    """Per row: doc_id, the rewritten text, how many values were replaced, and their kinds."""
    rows = pseudonymise(docs.select("doc_id", "text"), key)
    return rows.select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii")), ",").alias("kinds"))
