"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found values are checked before they count: card numbers by Luhn's digit, IBANs by their remainder, dates by the calendar,
addresses by their ranges, phone numbers by the numbering plan. A valid value is permuted by a keyed Feistel network within
the set of valid values of its format, and written with the separators it had, so that equal values stay linked across
documents and the pseudonym still parses:

* card: all digits but the last are permuted, the last is made anew;
* iban: the digits of the account part are permuted, the check digits made anew; country and letters stay;
* phone (+1 or ten digits in the North American plan's groups): area and exchange stay within 200-999, and an exchange below that
  stays below; an area below 200 counts only behind + or in brackets; other international numbers: the digits behind the country
  code's first two are permuted, and so are those behind the first two of 0X XX XX XX XX; ten digits in a row count behind a word like phone or call alone, or as all of a text;
* date (year 1900 to 2099, by numbers or with an English month): the day's number is permuted among the 73,051 days from 1900-01-01 on;
* ipv4: both halves are permuted; ipv6: the network's half is permuted, and under it the host's; ssn: area, group and serial stay
  within their ranges.

The network adds a keyed digest of one half to the other, modulo that half's size, `ROUNDS` times in turn; each step can be
undone, so the whole is a permutation, for halves of any two sizes. Emails and secrets (access keys and tokens by their prefix and length, web tokens,
private keys whole, values of passwords and the like) have no such format: a keyed digest replaces the local part and host, or as many characters as the secret had.

The key is the caller's: whoever has it can undo the permutations. Without one the session's setting `SETTING` holds, and if that
is unset it is drawn at random and kept there, so that values stay linked within the session and under no published key.

A pattern marks what it finds; texts are split at the marks; only marked pieces are looked at again. Texts without a mark
pass through as they are. A mark of a card or IBAN that fails its check may have taken in what stands before or behind a valid
value (an expiry, a currency): such marks are lifted, IBANs and cards in customary groups are looked for from each of the
text's words on, and what is then free is searched for the other kinds. Digits in other groups count as a card only alone:
one in ten runs of numbers has a part that passes Luhn's check.

Defined results: null text stays null, empty text empty; the characters U+E000 to U+E003 of the private use area, which
serve as marks, are kept (they are escaped and restored); equal rows give equal rows; empty tables give
none; very long texts are searched whole; other columns pass through unchanged, unless counts are wanted and they are named as those are (they are then replaced).
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
#: The session's key; Spark keeps settings that are called secret out of its pages and logs.
SETTING = "spark.skeinlake.pii.secret"
OPEN, CLOSE = "\ue000", "\ue001"
#: Stands where a card or IBAN may begin.
START = "\ue003"
#: Stand for the marks where a text has them itself: in turn, so that nothing is lost.
_ESCAPES = (("\ue002", "\ue002a"), (OPEN, "\ue002b"), (CLOSE, "\ue002c"), (START, "\ue002d"))

_SAID, _VALUE = "(?i:password|passwd|pwd|secret|token|api[_-]?key)", "[A-Za-z0-9/+_-]"
_HEX = "[0-9A-Fa-f]{1,4}"
#: What stands before a secret's value: a name and a sign, or a name and a verb.
_NAMED = rf"(?:{_SAID}\s?[=:]\s?|(?i:password|passwd|passcode|pwd)\s(?:is|was):?\s)[\"']?"
# Prefixes and lengths of tokens that services give out.
_TOKENS = (
    "AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", "gh[opsur]_[0-9A-Za-z]{36,255}", "github_pat_[0-9A-Za-z_]{22,255}", "sk-[0-9A-Za-z_-]{20,200}", "xox[abprs]-[0-9A-Za-z-]{10,200}",
    r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", "-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----[^-]{1,65536}+-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----",
)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + ")"
#: In order: where two could match at one place, the first counts.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}",
    "secret": "|".join(_TOKENS) + rf"|{_SAID}\s?[=:]\s?[\"']?(?:{_VALUE}{{8,}}(?:\.{_VALUE}{{2,}}){{0,4}}|(?=[A-Za-z/+_-]{{0,6}}[0-9]){_VALUE}{{3,7}})|{_SAID}=[\"']?{_VALUE}{{3,7}}"
    rf"|(?i:password|passwd|passcode|pwd)\s(?:is|was):?\s[\"']?(?=[A-Za-z/+_-]{{0,12}}[0-9]){_VALUE}{{4,}}",
    "iban": r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}[a-z0-9]{11,30})(?![A-Za-z0-9])",
    "date": rf"(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}})(?![0-9A-Za-z])",
    "ipv6": rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,39}}[0-9])(?:{_HEX}(?::{_HEX}){{0,5}})?::{_HEX}(?::{_HEX}){{0,5}})(?![0-9A-Za-z:])(?!\.[0-9])",
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+[0-9](?:[ .-]?\(?[0-9]\)?){7,13}(?![0-9A-Za-z])"
    r"|\([0-9]{3}\)[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|0[1-9](?:[ .-][0-9]{2}){4}(?![0-9A-Za-z]|[ .-][0-9])|(?:(?<=(?i:phone|mobile|call|tel|fax|cell)[.:]? {0,2})|^(?=[0-9]{10}$))[0-9]{10}(?![0-9A-Za-z])",
    "ssn": r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9A-Za-z])",
    "card": r"(?:[0-9](?:[ -]?[0-9]){12,18}|[0-9]{4}(?:\.[0-9]{4}){3})(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
#: All in one, behind nothing that continues a word or number. Repeats are bounded: no text, however long, backtracks far.
#: Four digits and a separator may begin a card behind letters as well.
_BEHIND = {"email": "(?<![A-Za-z0-9_.%+-])", "ipv4": r"(?<![A-Za-z0-9])(?<![0-9]\.)", "ipv6": "(?<![A-Za-z0-9:.])", "card": "(?:(?<![A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9]{4}[ -][0-9]{4,6}[ -]))"}


def _any(kinds) -> str:
    return "|".join(_BEHIND.get(k, "(?<![A-Za-z0-9])") + f"(?:{PATTERNS[k]})" for k in kinds)


ANY = _any(KINDS)
#: Kinds whose checks tell where a value ends, and the others.
CHECKED = ("iban", "card")
OTHERS = _any(k for k in KINDS if k not in CHECKED)
#: Cards in customary groups; their lengths and those of IBANs, separators included.
GROUPED = r"[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -](?:[0-9]{1,4}|[0-9]{4}[ -][0-9]{1,3})|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{6}[ -][0-9]{13}"
SHORTEST, LONGEST = 13, 43
#: A text without one of these can't hold a match: all but emails and secrets have two digits with at most these between them.
HINT = r"[0-9][ .()-]{0,3}[0-9]|@|AKIA|[=:]|gh[opsur]_|github_pat_|\bsk-|xox[abprs]-|eyJ|PRIVATE KEY|(?i:passw|passcode|pwd)"


def _digest(key: str, tag: str, *parts: Column) -> Column:
    """A keyed number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: str, *under: Column) -> Column:
    """A keyed permutation of the pairs 0 <= a < size_a, 0 <= b < size_b: struct(a, b), another for each value of `under`. Null sizes
    or values give nulls."""
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_a = F.when(even, (s["a"] + F.pmod(_digest(key, tag, i, s["b"], size_b, *under), size_a)) % size_a).otherwise(s["a"])
        moved_b = F.when(even, s["b"]).otherwise((s["b"] + F.pmod(_digest(key, tag, i, s["a"], size_a, *under), size_b)) % size_b)
        return F.struct(moved_a.alias("a"), moved_b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step)


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.split(s, "")


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Luhn's sum of the digits read from the right; whether the rightmost one is doubled."""
    each = F.transform(F.reverse(_chars(digits)), lambda d, i: _luhn_digit(d.cast("int"), (i + int(first_doubled)) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def _luhn_digit(d: Column, doubled: Column) -> Column:
    return F.when(~doubled, d).when(d > 4, 2 * d - 9).otherwise(2 * d)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the digit strings of one length (up to 36)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    got = feistel(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long"), _pow10(half), _pow10(n - half), key, tag)
    return F.when(n < 2, digits).otherwise(_bind(got, lambda g: F.concat(F.lpad(g["a"].cast("string"), half, "0"), F.lpad(g["b"].cast("string"), n - half, "0"))))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn."""
    zero = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(
        _chars(shape), zero,
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: acc["s"],
    )


def _is_card(s: Column) -> Column:
    d = _digits(s)
    return F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0)


def _card(s: Column, key: str) -> Column:
    d = _digits(s)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    made = _bind(permute_digits(body, key, "card"), lambda b: _refill(s, F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string"))))
    return F.when(_is_card(s), made)


def _mod97(s: Column) -> Column:
    """Of an IBAN's characters, country and check digits moved behind, letters as 10 to 35."""
    turned = _chars(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))))
    return F.aggregate(turned, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _is_iban(s: Column) -> Column:
    plain = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    return F.length(plain).between(15, 34) & (_mod97(F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), plain)) == 1)


def _iban(s: Column, key: str) -> Column:
    plain = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    account = F.substr(plain, F.lit(5))
    moved = permute_digits(_digits(account), key, "iban")

    def checked(digits: Column) -> Column:
        country = F.substr(plain, F.lit(1), F.lit(2))
        body = _refill(account, digits)
        check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return _refill(s, F.concat(check, digits))

    return F.when(_is_iban(s), _bind(moved, checked))


#: Days from 1900-01-01 to 2099-12-31: 229 x 319.
_DAYS, _WEST = (229, 319), "1900-01-01"


def _named_date(s: Column, key: str) -> Column:
    """A date whose month is written out or by three letters: the pseudonym's is too."""
    day_first = s.rlike("^[0-9]")
    words = F.split(F.replace(s, F.lit(","), F.lit("")), " ")
    at = lambda i, j: F.when(day_first, F.get(words, F.lit(i))).otherwise(F.get(words, F.lit(j)))
    name, listed = at(1, 0), F.array(*[F.lit(m) for m in _MONTHS])
    month = F.array_position(F.transform(listed, lambda m: F.left(m, F.lit(3))), F.lower(F.left(name, F.lit(3))))
    day = F.try_to_timestamp(F.concat(at(2, 2), F.lpad(month.cast("string"), 2, "0"), F.lpad(at(0, 1), 2, "0")), F.lit("yyyyMMdd")).cast("date")
    number = F.date_diff(day, F.lit(_WEST).cast("date"))
    valid = number.between(0, _DAYS[0] * _DAYS[1] - 1)

    def written(g: Column) -> Column:
        new = F.date_add(F.lit(_WEST).cast("date"), (g["a"] * _DAYS[1] + g["b"]).cast("int"))
        full = F.initcap(F.get(listed, F.month(new) - 1))
        named = F.when(F.length(name) > 3, full).otherwise(F.left(full, F.lit(3)))
        d, y = F.dayofmonth(new).cast("string"), F.date_format(new, "yyyy")
        return F.when(day_first, F.concat_ws(" ", d, named, y)).otherwise(F.concat(named, F.lit(" "), d, F.lit(", "), y))

    return F.when(valid, _bind(feistel(F.floor(number / _DAYS[1]), number % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date"), written))


def _date(s: Column, key: str) -> Column:
    return F.when(s.rlike("[A-Za-z]"), _named_date(s, key)).otherwise(_numeric_date(s, key))


def _numeric_date(s: Column, key: str) -> Column:
    parts = F.split(s, "[-/.]")
    year_first = s.rlike("^[0-9]{4}")
    part = lambda i, n: F.lpad(F.get(parts, F.lit(i)), n, "0")
    in_order = lambda y, m, d: F.concat(part(y, 4), part(m, 2), part(d, 2))
    day_first, month_first = in_order(2, 1, 0), in_order(2, 0, 1)
    parse = lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date")
    # Slashed dates have the day first unless that is no date and month first is.
    swapped = s.rlike("[-/]") & ~year_first & parse(day_first).isNull()
    day = parse(F.when(year_first, in_order(0, 1, 2)).when(swapped, month_first).otherwise(day_first))
    number = F.date_diff(day, F.lit(_WEST).cast("date"))
    valid = number.between(0, _DAYS[0] * _DAYS[1] - 1)
    mark = F.regexp_extract(s, "[-/.]", 0)
    bare = ~s.rlike("^[0-9]{2}[-/.][0-9]{2}[-/.]") & ~year_first  # a day or month of one digit: written without zeros

    def written(g: Column) -> Column:
        new = F.date_add(F.lit(_WEST).cast("date"), (g["a"] * _DAYS[1] + g["b"]).cast("int"))
        small = lambda full, short: F.when(bare, F.date_format(new, short)).otherwise(F.date_format(new, full))
        y, m, d = F.date_format(new, "yyyy"), small("MM", "M"), small("dd", "d")
        return F.when(year_first, F.concat_ws("\x00", y, m, d)).when(swapped, F.concat_ws("\x00", m, d, y)).otherwise(F.concat_ws("\x00", d, m, y))

    return F.when(valid, F.replace(_bind(feistel(F.floor(number / _DAYS[1]), number % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date"), written), F.lit("\x00"), mark))


def _ipv6(s: Column, key: str) -> Column:
    """Written in full: eight groups of four."""
    sides = F.split(s, "::")
    groups = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    gap = 8 - F.size(left) - F.size(right)
    valid = F.when(F.size(sides) == 1, gap == 0).otherwise(gap >= 1)
    zeros = F.when(gap > 0, F.array_repeat(F.lit("0"), gap)).otherwise(F.array().cast("array<string>"))
    digits = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    number = lambda i: F.conv(F.substring(digits, i, 8), 16, 10).cast("long")
    size = F.lit(1 << 32)
    word = lambda x: F.lpad(F.lower(F.conv(x.cast("string"), 10, 16)), 8, "0")
    network = feistel(number(1), number(9), size, size, key, "ipv6")
    both = lambda n: _bind(feistel(number(17), number(25), size, size, key, "ipv6-host", n["a"], n["b"]), lambda h: F.concat(*[word(x) for x in (n["a"], n["b"], h["a"], h["b"])]))
    return F.when(valid, F.regexp_replace(_bind(network, both), "(.{4})(?=.)", "$1:"))


def _ipv4(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    at = lambda i: F.get(o, F.lit(i))
    valid = ~F.exists(o, lambda x: x > 255)
    got = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), key, "ipv4")
    return F.when(valid, _bind(got, lambda g: F.concat_ws(".", *[F.floor(g[h] / 256) if hi else g[h] % 256 for h in "ab" for hi in (1, 0)])))


def _phone(s: Column, key: str) -> Column:
    d = _digits(s)
    ten = F.right(d, F.lit(10))
    plus = s.startswith("+")
    nanp = (F.length(d) == 10) & ~plus | (F.length(d) == 11) & d.startswith("1")
    area, exchange, line = (F.substring(ten, i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
    # Area and exchange from 200 on are valid; others are permuted among their like.
    low_area, low_exchange = area < 200, exchange < 200
    first = F.when(low_area, F.lit(0)).otherwise(F.lit(200))
    second = F.when(low_area | low_exchange, F.lit(0)).otherwise(F.lit(200))
    sizes = F.when(low_area, 200).otherwise(800), F.when(low_area, 10_000_000).when(low_exchange, 2_000_000).otherwise(8_000_000)
    meant = nanp & (~low_area | plus | s.contains("("))
    got = feistel(area - first, (exchange - second) * 10_000 + line, *sizes, key, "phone")
    head = F.substr(d, F.lit(1), F.length(d) - 10)
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    american = _bind(got, lambda g: _refill(s, F.concat(head, padded(g["a"] + first, 3), padded(F.floor(g["b"] / 10_000) + second, 3), padded(g["b"] % 10_000, 4))))
    abroad = plus & ~nanp & F.length(d).between(8, 15)
    foreign = _refill(s, F.concat(F.substring(d, 1, 2), permute_digits(F.substr(d, F.lit(3)), key, "phone")))
    national = (F.length(d) == 10) & s.rlike("^0[1-9][ .-]")
    return F.when(abroad | national, foreign).when(meant, american)


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    packed = F.when(area > 666, area - 2).otherwise(area - 1)
    got = feistel(packed, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    number = lambda g: F.when(g["a"] > 664, g["a"] + 2).otherwise(g["a"] + 1)
    return F.when(valid, _bind(got, lambda g: _refill(s, F.concat(F.lpad(number(g).cast("string"), 3, "0"), F.lpad((F.floor(g["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((g["b"] % 9999 + 1).cast("string"), 4, "0")))))


def _hexed(s: Column, key: str, tag: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), s), 256)


def _email(s: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_hexed(F.lower(s), key, "email"), 1, 16), F.lit("@"), F.substring(_hexed(F.lower(F.substring_index(s, "@", -1)), key, "host"), 1, 8), F.lit(".example"))


def _secret(s: Column, key: str) -> Column:
    head = F.regexp_extract(s, f"^({_NAMED})", 1)
    value = F.substr(s, F.length(head) + 1)
    return F.concat(head, F.substr(F.repeat(_hexed(value, key, "secret"), F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value)))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ipv6": _ipv6, "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "card": _card}


def _swap(s: Column, pairs) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def _count(parts: Column, kind: str) -> Column:
    return F.size(F.filter(parts, lambda p: p["kind"] == kind))


def _whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def _failing(s: Column) -> Column:
    """Whether a mark is that of a card or IBAN, of no other kind, and fails the check."""
    other = "|".join(_whole(k) for k in KINDS if k not in CHECKED)
    card, iban = s.rlike(_whole("card")), s.rlike(_whole("iban"))
    return (card | iban) & ~s.rlike(other) & ~F.when(card, F.coalesce(_is_card(s), F.lit(False))).otherwise(F.coalesce(_is_iban(s), F.lit(False)))


def _valid_length(s: Column) -> Column:
    """Of the longest IBAN or grouped card that s begins with and that ends where a word does; null if there is none."""

    def valid(n: Column) -> Column:
        head = F.substr(s, F.lit(1), n)
        ends = (F.length(s) >= n) & ~F.substr(s, n + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        return ends & F.when(head.rlike(f"^(?:{GROUPED})$"), _is_card(head)).when(head.rlike(_whole("iban")), _is_iban(head)).otherwise(False)

    return F.array_max(F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), valid))


def _marked_anew(pieces: Column) -> Column:
    """The marked text of pieces with failing marks lifted and the values that they hid marked.

    A place where a card or IBAN may begin gets START and, if a valid one does, its length as a character. One replacement
    from left to right then marks values that don't overlap, so the work is in proportion to the text.
    """
    lifted = F.array_join(F.transform(pieces, lambda s, i: F.when((i % 2 == 0) | _failing(s), s).otherwise(F.concat(F.lit(OPEN), s, F.lit(CLOSE)))), "")
    begins = f"(?:{GROUPED})(?![0-9A-Za-z])|{PATTERNS['iban']}"
    begun = F.split(F.regexp_replace(lifted, f"{OPEN}[^{CLOSE}]*{CLOSE}|(?:(?<![A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9]{{4}}[ -][0-9]{{4,6}}[ -]))(?={begins})", f"$0{START}"), START)

    def placed(begun: Column, near: Column) -> Column:
        def begin(s: Column, i: Column) -> Column:
            behind = F.left(F.array_join(F.slice(near, i + 1, F.lit(LONGEST // 2 + 2)), ""), F.lit(LONGEST + 1))
            return F.when(i == 0, s).otherwise(_bind(_valid_length(behind), lambda n: F.when(n.isNull(), s).otherwise(F.concat(F.lit(START), F.char(n + 32), s))))

        return F.array_join(F.transform(begun, begin), "")

    # What stands behind a place: the next ones follow after two characters or more.
    coded = _bind(begun, lambda b: _bind(F.transform(b, lambda s: F.left(s, F.lit(LONGEST + 1))), lambda near: placed(b, near)))
    taken = "|".join(rf"{START}\x{{{n + 32:x}}}(?:(?:{START}.)?[^{START}]){{{n}}}" for n in range(SHORTEST, LONGEST + 1))
    found = F.regexp_replace(F.regexp_replace(coded, taken, f"{OPEN}$0{CLOSE}"), f"{START}.", "")
    return F.regexp_replace(found, f"{OPEN}([^{CLOSE}]*){CLOSE}|({OTHERS})", f"{OPEN}$1$2{CLOSE}")


def session_key(spark: SparkSession) -> str:
    """The session's key; drawn now if it has none."""
    key = spark.conf.get(SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(SETTING, key)
    return key


def pseudonymize(docs: DataFrame, key: str | None = None, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with the text's values replaced under the key (none: the session's), and, if wanted, for each kind the number replaced:
    n_email, n_secret, ..."""
    key = key or session_key(docs.sparkSession)
    source = F.col(f"`{text}`")
    safe = F.when(source.rlike("[\ue000-\ue003]"), _swap(source, _ESCAPES)).otherwise(source)
    marked = F.when(source.rlike(HINT), F.regexp_replace(safe, ANY, f"{OPEN}$0{CLOSE}")).otherwise(F.lit(""))
    at_marks = lambda s: F.split(s, f"[{OPEN}{CLOSE}]")
    hides = lambda ps: F.exists(F.transform(ps, lambda s, i: (i % 2 == 1) & _failing(s)), lambda x: x)
    pieces = F.when(marked.contains(OPEN), _bind(at_marks(marked), lambda ps: F.when(hides(ps), at_marks(_marked_anew(ps))).otherwise(ps)))

    def made(s: Column) -> Column:
        """What becomes of a marked piece: kind and text; a value that its check rejects is left as it is."""
        tries = F.array(*[F.when(s.rlike(_whole(k)), F.struct(F.lit(k).alias("kind"), make(s, key).alias("text"))) for k, make in _MAKERS.items()])
        good = F.filter(tries, lambda t: t["text"].isNotNull())
        return F.coalesce(F.get(good, F.lit(0)), F.struct(F.lit(None).cast("string").alias("kind"), s.alias("text")))

    # Between marks lies what was outside and inside in turn; splitting yields them at even and odd places.
    parts = F.transform(pieces, lambda s, i: F.when(i % 2 == 1, made(s)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), s.alias("text"))))
    held = "__parts"
    while held in docs.columns:
        held += "_"
    out = docs.withColumn(held, parts)
    done = F.col(held)
    numbers = {f"n_{k}": F.when(done.isNull(), 0).otherwise(_count(done, k)) for k in KINDS} if counts else {}
    return out.withColumns({text: F.when(done.isNull(), source).otherwise(_swap(F.array_join(F.transform(done, lambda p: p["text"]), ""), [(b, a) for a, b in reversed(_ESCAPES)]))} | numbers).drop(held)
