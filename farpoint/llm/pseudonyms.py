"""Format-preserving pseudonyms for personal numbers, addresses and dates, in column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEFAULT_KEY = "change me"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"

_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)[0-9]{2}"
# What is looked for, in this order at each place of a text. Runs are possessive or bounded, so a search is linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_BYTE}\.){{3}}{_BYTE}(?!\.?[0-9])",
    "date": rf"(?<![0-9])(?:{_YEAR}-{_MONTH}-{_DAY}|{_YEAR}/{_MONTH}/{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_MONTH}/{_DAY}/{_YEAR})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "social": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DATE_FORMS = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{4}/": "yyyy/MM/dd", r"^[0-9]{2}\.": "dd.MM.yyyy", r"^[0-9]{2}/": "MM/dd/yyyy"}
# Days from 1900-01-01 to 2099-12-31, as a product of two moduli.
FIRST_DAY, DAY_MODULI = "1900-01-01", (17, 4297)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _digest(key: str, tag: str, number: Column, other: Column) -> Column:
    """Keyed round function: 128 hexadecimal digits."""
    return F.sha2(F.concat_ws("/", F.lit(key), F.lit(tag), number.cast("string"), other), 512)


def _number(digest: Column, first: int = 1, size: int = 14) -> Column:
    return F.conv(F.substring(digest, first, size), 16, 10).cast("bigint")


def _feistel(left: Column, right: Column, moduli: tuple[int, int], key: str, tag: str) -> Column:
    """Keyed permutation of pairs of numbers below the moduli, as struct ``a``, ``b``."""
    shift = lambda own, other, modulus, r: F.pmod(own + F.pmod(_number(_digest(key, tag, r, other.cast("string"))), F.lit(modulus)), F.lit(modulus))

    def turn(s: Column, r: Column) -> Column:
        a = F.when(r % 2 == 0, shift(s["a"], s["b"], moduli[0], r)).otherwise(s["a"])
        b = F.when(r % 2 == 1, shift(s["b"], s["a"], moduli[1], r)).otherwise(s["b"])
        return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _feistel_text(text: Column, alphabets: Column, key: str, tag: str) -> Column:
    """Keyed permutation of texts that keeps each character in its alphabet, and others in place.

    The halves take turns: each character of one is moved on in its alphabet by a keyed hash of the
    other half, case left out, so spellings in upper and lower case stay linked.
    """

    def moved(half: Column, other: Column, r: Column) -> Column:
        def one(digest: Column) -> Column:
            def step(c: Column, i: Column) -> Column:
                by = F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                own = F.try_element_at(F.filter(alphabets, lambda a: F.contains(a, c)), F.lit(1))
                place = F.pmod(F.position(c, own) - 1 + by, F.length(own))
                return F.coalesce(F.substr(own, place + 1, F.lit(1)), c)

            return F.array_join(F.transform(_chars(half), step), "")

        return _let(_digest(key, tag, r, F.lower(other)), one)

    def turn(s: Column, r: Column) -> Column:
        a = F.when(r % 2 == 0, moved(s["a"], s["b"], r)).otherwise(s["a"])
        b = F.when(r % 2 == 1, moved(s["b"], s["a"], r)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    def permuted(whole: Column) -> Column:
        half = F.floor(F.length(whole) / 2).cast("int")
        start = F.struct(F.substr(whole, F.lit(1), half).alias("a"), F.substr(whole, half + 1, F.length(whole)).alias("b"))
        return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda s: F.concat(s["a"], s["b"]))

    return _let(text, permuted)


def _alphabets(*letters: str) -> Column:
    return F.array(*[F.lit(x) for x in letters])


def _keep_marks(text: Column, digits: Column) -> Column:
    """``digits`` put in the places of the digits of ``text``, other characters as they are."""
    before = lambda i: F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[^0-9]", ""))
    put = lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, before(i) + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(_chars(text), put), "")


def luhn_digit(body: Column) -> Column:
    """Check digit of a number without it."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int"))
    folded = F.transform(F.transform(F.reverse(_chars(body)), value), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.pmod(10 - F.aggregate(folded, F.lit(0), lambda s, v: s + v) % 10, F.lit(10))


def _numbers(text: Column, key: str, tag: str, kept: str = "") -> Column:
    """Digits permuted in place; what ``kept`` matches at the start stays."""
    head = F.regexp_extract(text, f"^{kept}", 0) if kept else F.lit("")

    def rest(tail: Column) -> Column:
        digits = F.regexp_replace(tail, "[^0-9]", "")
        return _let(_feistel_text(digits, _alphabets(DIGITS), key, tag), lambda d: _keep_marks(tail, d))

    return F.concat(head, _let(F.substr(text, F.length(head) + 1, F.length(text)), rest))


def _luhn_valid(text: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    ends = lambda d: luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)).cast("int")
    return _let(F.regexp_replace(text, "[^0-9]", ""), ends)


def _card(text: Column, key: str) -> Column:
    """All digits of a valid number but the last are permuted; the last is the Luhn digit of the new ones."""

    def whole(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        new = _feistel_text(body, _alphabets(DIGITS), key, "card")
        return _let(new, lambda b: F.concat(b, luhn_digit(b).cast("string")))

    return _let(F.regexp_replace(text, "[^0-9]", ""), lambda d: _let(whole(d), lambda n: _keep_marks(text, n)))


def _email(text: Column, key: str) -> Column:
    """Letters and digits permuted, but for the last label of the host."""
    last = F.regexp_extract(text, r"\.[^.]*$", 0)
    front = F.substr(text, F.lit(1), F.length(text) - F.length(last))
    return F.concat(_feistel_text(front, _alphabets(DIGITS, LOWER, UPPER), key, "email"), last)


def _secret(text: Column, key: str) -> Column:
    alphabet = F.when(text.rlike("[A-F]"), F.lit(HEX_UPPER)).otherwise(F.lit(HEX))
    return _feistel_text(text, F.array(alphabet), key, "secret")


def _address(text: Column, key: str) -> Column:
    """Four bytes permuted as two 16-bit numbers."""

    def pair(p: Column) -> Column:
        at = lambda i: F.element_at(p, i).cast("bigint")
        new = _feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), (65_536, 65_536), key, "ip")
        byte = lambda v, i: (F.floor(v / 256) if i == 0 else v % 256).cast("int").cast("string")
        return _let(new, lambda s: F.concat_ws(".", byte(s["a"], 0), byte(s["a"], 1), byte(s["b"], 0), byte(s["b"], 1)))

    return _let(F.split(text, r"\."), pair)


def _date(text: Column, key: str) -> Column:
    """The day permuted among all days of two centuries, in the same form; impossible dates stay."""
    low = DAY_MODULI[1]

    def formed(form: str) -> Column:
        def day(d: Column) -> Column:
            n = F.datediff(d, F.to_date(F.lit(FIRST_DAY)))
            new = _feistel(F.floor(n / low), n % low, DAY_MODULI, key, "date")
            return _let(new, lambda s: F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["a"] * low + s["b"]).cast("int")), form))

        return F.coalesce(_let(F.try_to_timestamp(text, F.lit(form)).cast("date"), day), text)

    chosen = text
    for start, form in DATE_FORMS.items():
        chosen = F.when(text.rlike(start), formed(form)).otherwise(chosen)
    return chosen


def _is(found: Column, kind: str) -> Column:
    return found.rlike(f"^(?:{PATTERNS[kind]})$")


def valid(found: Column) -> Column:
    """Whether a text that one of the patterns matches is a private value: dates exist, account numbers have their Luhn digit."""
    exists = F.lit(False)
    for start, form in DATE_FORMS.items():
        exists = F.when(found.rlike(start), F.try_to_timestamp(found, F.lit(form)).isNotNull()).otherwise(exists)
    return F.when(_is(found, "date"), exists).when(_is(found, "card"), _luhn_valid(found)).otherwise(True)


def pseudonym(found: Column, key: str) -> Column:
    """Pseudonym of a private value that one of the patterns matches."""
    whole = lambda kind: _is(found, kind)
    return (
        F.when(F.contains(found, F.lit("@")), _email(found, key))
        .when(whole("secret"), _secret(found, key))
        .when(whole("ip"), _address(found, key))
        .when(whole("date"), _date(found, key))
        .when(whole("social"), _numbers(found, key, "social"))
        .when(whole("card"), _card(found, key))
        .otherwise(_numbers(found, key, "phone", r"(?:\+[0-9]{1,3}(?=[ .\-(]))?"))
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, found: str = "n_private") -> DataFrame:
    """``docs`` with private values of ``text`` replaced, and their number as ``found``.

    E-mail addresses, hexadecimal secrets, IPv4 addresses, dates, telephone, social security and account numbers
    are checked by form (bytes, calendar, Luhn digit) and permuted within it by a keyed Feistel network, so equal
    values have equal pseudonyms in all documents, and different ones of a form different pseudonyms. All other text
    stays byte for byte and is not counted, dates that don't exist and numbers without their Luhn digit included. NULL text stays NULL with 0 found; empty and very long texts, repeated rows
    and ties need no care, as each row is worked out alone. A column called like ``found`` is
    replaced; others pass through. An empty table gives an empty table.
    """
    value = F.col(f"`{text}`")
    matches = F.regexp_extract_all(value, F.lit(ANY), F.lit(0))
    new = F.transform(matches, lambda m: F.when(valid(m), pseudonym(m, key)).otherwise(m))
    joined = F.zip_with(F.split(value, ANY), new, lambda part, m: F.concat(F.coalesce(part, F.lit("")), F.coalesce(m, F.lit(""))))
    searched = value.rlike("[0-9@]")
    rewritten = F.when(searched, F.array_join(joined, "")).otherwise(value)
    count = F.when(searched, F.size(F.filter(matches, valid))).otherwise(0).cast("int")
    return docs.select(*[(rewritten if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns if c != found], count.alias(found))
