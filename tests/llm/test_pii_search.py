"""Personal data in running text: against a finder that tries every span, and kinds and formats one by one."""

import random
import re

import pytest

from skeinlake.llm import pii

GROUPS = {(4, 4, 4, n) for n in (1, 2, 3, 4)} | {(4, 4, 4, 4, n) for n in (1, 2, 3)} | {(4, 6, 4), (4, 6, 5), (6, 13)} | {(n,) for n in range(13, 20)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(s: str, grouped: bool) -> bool:
    parts = re.split("[ -]", s)
    digits = "".join(parts)
    if not all(re.fullmatch("[0-9]+", p) for p in parts) or not 13 <= len(digits) <= 19:
        return False
    return (not grouped or tuple(map(len, parts)) in GROUPS) and luhn(digits)


def is_iban(s: str) -> bool:
    plain = s.replace(" ", "")
    if not re.fullmatch("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", s) or not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def begins(text: str, i: int) -> bool:
    return i == 0 or not word(text[i - 1]) or text[i - 1].isalpha() and bool(re.match("[0-9]{4}[ -][0-9]{4,6}[ -]", text[i:]))


def spans(text: str) -> list[tuple[int, int]]:
    """Runs of digits in any groups that are one card, and IBANs, alone in their surroundings; then, outside those, the longest valid
    span from each place on where a word begins."""
    alone, i = [], 0
    while i < len(text):
        found = begins(text, i) and (re.compile(pii.PATTERNS["iban"]).match(text, i) or re.compile(pii.PATTERNS["card"]).match(text, i))
        if found:
            if is_iban(found[0]) or is_card(found[0], False):
                alone.append(found.span())
            i = found.end()
        else:
            i += 1
    out, i = list(alone), 0
    taken = {k for a, b in alone for k in range(a, b)}
    while i < len(text):
        best = 0
        if i not in taken and begins(text, i):
            for n in range(13, 44):
                s = text[i : i + n]
                if len(s) < n or any(k in taken for k in range(i, i + n)):
                    break
                if (i + n == len(text) or not word(text[i + n])) and (is_card(s, True) or is_iban(s)):
                    best = n
        if best:
            out.append((i, i + best))
        i += best or 1
    return sorted(out)


def made_card(rng: random.Random) -> str:
    sizes = rng.choice(sorted(GROUPS))
    digits = "".join(rng.choice("0123456789") for _ in range(sum(sizes)))
    digits = next(d for d in (digits[:-1] + c for c in "0123456789") if luhn(d))
    mark, at, parts = rng.choice(" -"), 0, []
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return mark.join(parts)


def made_iban(rng: random.Random) -> str:
    body = "".join(rng.choice("0123456789" if rng.random() < 0.9 else "ABCD") for _ in range(rng.randrange(11, 27)))
    country = rng.choice(("DE", "FR", "NO", "MT"))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    plain = f"{country}{check:02d}{body}"
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if rng.random() < 0.5 else plain


def random_text(rng: random.Random) -> str:
    """Values among numbers of lengths that make no phone number, words and capital words."""
    kinds = (lambda: made_card(rng), lambda: made_iban(rng), lambda: str(rng.randrange(10 ** rng.choice((1, 2, 4)))), lambda: str(rng.randrange(10**15, 10**17)), lambda: rng.choice(("EUR", "FROM", "DE", "WITH")), lambda: rng.choice(("to", "an order", "id")))
    out = []
    for _ in range(rng.randrange(1, 8)):
        out += [rng.choice(kinds)(), rng.choice((" ", " ", " ", ", ", "\n", "; "))]
    if rng.random() < 0.1:
        out.insert(0, rng.choice(("x", "id")))
    return "".join(out)


def test_every_valid_card_and_iban_is_found(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.pseudonymize(rows, "a key of the test").collect()}
    wrong = []
    for i, text in enumerate(texts):
        r, want, at, pattern = got[i], spans(text), 0, ""
        for a, b in want:
            pattern += re.escape(text[at:a]) + f".{{{b - a}}}"
            at = b
        changed = all(text[a:b] != r["text"][a:b] for a, b in want)
        if r["n_card"] + r["n_iban"] != len(want) or not re.fullmatch(pattern + re.escape(text[at:]), r["text"], re.DOTALL) or not changed:
            wrong.append((text, want, r["text"]))
    assert sum(len(spans(t)) for t in texts) > 2000
    assert not wrong, (len(wrong), wrong[:3])


def masked(spark, *texts: str):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.asDict() for r in pii.pseudonymize(rows, "k").orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    ("kind", "text", "form"),
    [
        ("card", "id4111 1111 1111 1111.", r"id\d{4} \d{4} \d{4} \d{4}\."), ("secret", "password: hunter2 x", r"password: [0-9a-f]{7} x"), ("secret", "token=abc;", "token=[0-9a-f]{3};"),
        ("secret", "token: eyJhbGciOi.eyJzdWIi.SflKxw end", "token: [0-9a-f]{26} end"), ("ssn", "ssn 123 45 6789", r"ssn \d{3} \d\d \d{4}"), ("date", "on 5/7/1990.", r"on \d{1,2}/\d{1,2}/(19|20)\d\d\."),
        ("date", "on 5.7.1990", r"on \d{1,2}\.\d{1,2}\.(19|20)\d\d"), ("phone", "555-123-4567", r"[2-9]\d\d-[01]\d\d-\d{4}"), ("ipv6", "from 2001:db8::ff00:42:8329,", "from (?:[0-9a-f]{4}:){7}[0-9a-f]{4},"), ("ipv6", "fe80::1", "(?:[0-9a-f]{4}:){7}[0-9a-f]{4}"),
    ],
)
def test_formats(spark, kind, text, form):
    got = masked(spark, text)[0]
    assert got[f"n_{kind}"] == 1 and re.fullmatch(form, got["text"]) and got["text"] != text


def test_clean_texts_stay(spark):
    texts = ["the password: needed; token: a word; secret = garden", "12:34:56 aa:bb:cc:dd:ee:ff std::vector x::1", "13/13/1990 31/2/1990 1/2/3 version 1.2.3", "pages 123-456 and 12 345 678", "a::b and dead::beef"]
    assert [r["text"] for r in masked(spark, *texts)] == texts


def test_equal_values_stay_linked(spark):
    dates, ips, ssns = masked(spark, "5/7/1990 05/07/1990 5.7.1990 1990-07-05", "2001:db8::ff00:42:8329 2001:0DB8:0000:0000:0000:ff00:0042:8329", "123-45-6789 123 45 6789")
    a, b, c, d = dates["text"].split(" ")
    assert [int(x) for x in a.split("/")] == [int(x) for x in b.split("/")] == [int(x) for x in c.split(".")] == [int(x) for x in d.split("-")[::-1]]
    assert len(set(ips["text"].split(" "))) == 1 and len({re.sub("[ -]", "", x) for x in (ssns["text"][:11], ssns["text"][12:])}) == 1


def test_the_key_is_the_callers(spark):
    """Another key, other pseudonyms; the session's own is drawn once and no part of the library."""
    rows = spark.createDataFrame([(1, "8.8.8.8 1999-12-31")], "doc_id int, text string")
    a, b = (pii.pseudonymize(rows, k).first()["text"] for k in "ab")
    assert a != b and pii.pseudonymize(rows, "a").first()["text"] == a
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) >= 32
    assert pii.pseudonymize(rows).first()["text"] == pii.pseudonymize(rows, pii.session_key(spark)).first()["text"]
    assert pii.pseudonymize(rows, "a", counts=False).columns == rows.columns


def test_long_text(spark):
    text = "plain words here, " * 300_000 + "4111 1111 1111 1111 12/27 and 8.8.8.8"
    got = masked(spark, text)[0]
    assert (got["n_card"], got["n_ipv4"]) == (1, 1) and len(text) > 5_000_000 and got["text"].startswith("plain words here, " * 300_000)
