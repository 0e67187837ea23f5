"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

Values are found by patterns, in a few passes, validated, and replaced by a keyed permutation of their
own format, so a value gets the same pseudonym in every document and two values never
share one:

- payment cards of 13 to 19 digits that pass Luhn: the payload is permuted and its check
  digit computed anew; separators stay;
- IBANs that pass mod 97: the digits of the account are permuted, check digits computed anew;
- phone numbers, + and 8 to 15 digits with blanks, dots, hyphens or brackets, or national as
  (ddd) ddd-dddd and ddd-ddd-dddd, and US social security numbers: their digits, but for the
  country code;
- dates, year-month-day, day/month/year or, where that is no date, month/day/year, from 1900
  to 2099: to another day of that range;
- IPv4 addresses: to another address;
- e-mail addresses and secrets (a name such as token or api_key, then = or : and 16 or more
  characters, or a password of 8 or more with a digit or mark, or in quotes) are no numbers;
  a keyed digest in letters and digits replaces the whole address or secret, of any length.
  A secret keeps its length.

The key is an argument or the Spark setting spark.studyloom.pii.key.

Cards and IBANs are looked for within runs of groups, as a check value, an order number or
a word may stand next to them: of the parts that begin and end at a separator and pass the
check, longer ones come first. A card that is only a part of its run has three or more
digits in each group but the last, or lists of small numbers would be full of cards.

Numbers that fail their check are left alone, and what they hold is searched on for the
kinds that come later. Permutations are ten-round Feistel networks over two halves of the
digits (as in FF1), walked until the value is valid again.

Defined cases: null text stays null and an empty one empty; a text of any length is
handled whole; rows are treated one by one; other columns, whatever their names, stay.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.names import free

#: The Spark setting that holds the key; who knows the key can undo the pseudonyms.
KEY_SETTING = "spark.studyloom.pii.key"
#: For demonstrations, where the setting is missing.
KEY = "studyloom-demonstration-key"
ROUNDS = 10

#: The local part is the whole run in front of the @, however long; a domain has 253 characters at most.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
#: Keys and tokens of 16 or more characters; passwords of 8 or more, one of them a digit or mark, or any in quotes.
_NAMED = r"(?i:(?<![A-Za-z0-9])(?:token|secret|api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?)(?:(?i:bearer)[ ])?[A-Za-z0-9+/_.~=-]{16,}+[\"']?"
_PASSWORD = r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd)[ ]{0,3}[=:][ ]{0,3})(?:\"[^\"\\s]{4,}+\"|'[^'\\s]{4,}+'|(?=[^\\s\"']*[0-9!@#$%^&*?~+])[^\\s\"']{8,}+)"
SECRET = f"{_NAMED}|{_PASSWORD}".replace("\\\\", "\\")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SEP = r"(?:[ .-]|[ .-]?[()][ .-]?)?"
#: +cc (area) number; +1 and ten digits; + and 8 to 15 digits, which end before the groups of a card.
_CARD_NEXT = r"[ ](?:(?:[0-9]{4}[ -]?){3}[0-9]|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4})"
ABROAD = rf"(?<![0-9])\+(?:[0-9]{{1,3}}[ ]?\([0-9]{{2,4}}\)[ ]?[0-9]{{3,4}}[ -]?[0-9]{{3,4}}|1(?:{_SEP}[0-9]){{10}}|[0-9](?:(?!{_CARD_NEXT}){_SEP}[0-9]){{7,14}})(?![0-9])"
#: (ddd) ddd-dddd and ddd-ddd-dddd, with or without 1 in front; with blanks alone, only if no digits are near.
HOME = r"(?:(?<![0-9+])1[ .-]?)?(?<![0-9)])(?<!\+[0-9]{1,3}[ .-]?)\([0-9]{3}\)[ ]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9.+-])(?<!\+[0-9]{1,3}[ .-]?)(?:1[ .-])?[0-9]{3}(?:[.-][0-9]{3}[ .-]|[ ][0-9]{3}[.-])[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9.+-])(?<![0-9+)][ .-]?)[2-9][0-9]{2}[ ][2-9][0-9]{2}[ ][0-9]{4}(?![ .-]?[0-9])"
PHONE = f"{ABROAD}|{HOME}"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: In the order of the report.
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "phone": PHONE, "date": DATE, "ssn": SSN, "ipv4": IPV4, "card": CARD}
#: What a pass looks for in the text that the passes before it left.
PASSES = [("email", "secret"), ("iban",), ("phone", "date", "ssn", "ipv4"), ("card",)]
#: All groups that a card or an IBAN may be a part of; possessive, so long ones don't recurse.
CARD_RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
IBAN_RUN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:[ ][A-Z0-9]++(?![a-z]))*+"


def key_of(docs: DataFrame) -> str:
    found = docs.sparkSession.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with the demonstration key", stacklevel=2)
    return found or KEY


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _noise(key: str, tweak: str, step: Column, value: Column) -> Column:
    """A keyed pseudorandom whole number below 2**60."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: str) -> Column:
    """(a, b) permuted, 0 <= a < size_a and 0 <= b < size_b; an even number of rounds keeps the sizes in place."""

    def step(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b)
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + F.pmod(_noise(key, tweak, i, acc["b"]), size), size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many digits, for 2 to 36 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    pow10 = lambda k: F.pow(F.lit(10.0), k).cast("long")
    halves = _feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n), pow10(u), pow10(n - u), key, tweak)
    halves = _let(halves, lambda h: F.concat(F.lpad(h["a"].cast("string"), u, F.lit("0")), F.lpad(h["b"].cast("string"), n - u, F.lit("0"))))
    return halves


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column, first: int = 1) -> Column:
    """value with its digits from position first on replaced in order; other characters stay."""

    def step(acc: Column, ch: Column) -> Column:
        swap = ch.rlike("[0-9]") & (acc["seen"] >= first - 1)
        return F.struct(
            F.concat(acc["out"], F.when(swap, F.substring(digits, acc["k"], F.lit(1))).otherwise(ch)).alias("out"),
            (acc["k"] + F.when(swap, 1).otherwise(0)).alias("k"),
            (acc["seen"] + 1).alias("seen"),
        )

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k"), F.lit(0).alias("seen")), step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card_digits(d: Column) -> Column:
    return F.length(d).between(13, 19) & _luhn(d)


def card(value: Column, key: str) -> Column:
    def renew(d: Column) -> Column:
        payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = _let(payload, lambda p: F.concat(p, F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn(F.concat(p, c.cast("string"))))[0].cast("string")))
        return F.when(_luhn(d), _let(whole, lambda w: _refill(value, w))).otherwise(value)

    return _let(_digits(value), renew)


def _mod97(text: Column) -> Column:
    """The number that text stands for, A = 10 to Z = 35, modulo 97."""

    def step(acc: Column, ch: Column) -> Column:
        digit = ch.rlike("[0-9]")
        return F.when(digit, (acc * 10 + ch.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_letters(v: Column) -> Column:
    account = F.substring(v, F.lit(5), F.length(v))
    return (F.length(v) <= 34) & (_mod97(F.concat(account, F.substring(v, 1, 4))) == 1) & F.length(_digits(account)).between(4, 30)


def iban(value: Column, key: str) -> Column:
    def renew(v: Column) -> Column:
        account = F.substring(v, F.lit(5), F.length(v))
        country = F.substring(v, 1, 2)

        def checked(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return _refill(value, F.concat(check, _digits(new)), 1)

        new = _refill(account, permute_digits(_digits(account), key, "iban"))
        return F.when(_iban_letters(v), _let(new, checked)).otherwise(value)

    return _let(F.regexp_replace(value, " ", ""), renew)


def phone(value: Column, key: str) -> Column:
    """The country code stays: 1 before a national number, or the digits before a bracket or separator, else 1, 7 or two digits."""
    head = F.when(value.startswith("+"), F.regexp_extract(value, r"^\+(?:[0-9]{1,3}(?=[ .()-])|[17]|[0-9]{2})", 0)).otherwise(F.regexp_extract(value, r"^1(?=[ .(-])", 0))
    return _let(head, lambda h: _let(F.substring(value, F.length(h) + 1, F.length(value)), lambda r: F.concat(h, _refill(r, permute_digits(_digits(r), key, "phone")))))


def _ssn_digits(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")


def ssn(value: Column, key: str) -> Column:
    valid = _ssn_digits
    walked = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(64)), permute_digits(d, key, "ssn"), lambda x, _: F.when(valid(x), x).otherwise(permute_digits(x, key, "ssn")))
    return _let(_digits(value), lambda d: F.when(valid(d), _let(walked(d), lambda w: _refill(value, w))).otherwise(value))


FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31


def _month_first(value: Column) -> Column:
    """Whether value is month/day/year: a slash date that is no day/month/year."""
    return value.rlike("^(0[1-9]|1[0-2])/(1[3-9]|2[0-9]|3[01])/")


def _day(value: Column) -> Column:
    parts = F.split(value, "[-./]")
    text = F.when(value.rlike("^[0-9]{4}-"), value).when(_month_first(value), F.concat_ws("-", parts[2], parts[0], parts[1])).otherwise(F.concat_ws("-", parts[2], parts[1], parts[0]))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def date(value: Column, key: str) -> Column:
    """A day of 1900-2099 is a number below 73049; it's walked among five digits until it is one again.

    A month/day date becomes another day after the 12th, so it can't be read as day/month.
    """
    iso, us = value.rlike("^[0-9]{4}-"), _month_first(value)
    at = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))

    def renew(day: Column) -> Column:
        once = lambda x: permute_digits(F.lpad(x, 5, "0"), key, "date")
        good = lambda x: (x.cast("int") < DAYS) & (~us | (F.dayofmonth(at(x)) > 12))
        start = once(F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("string"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, lambda x, _: F.when(good(x), x).otherwise(once(x)))
        shown = lambda d, a, b: F.concat(F.date_format(d, a), F.substring(value, 3, 1), F.date_format(d, b), F.substring(value, 6, 1), F.date_format(d, "yyyy"))
        new = _let(at(walked), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(us, shown(d, "MM", "dd")).otherwise(shown(d, "dd", "MM")))
        return F.when(day.isNotNull(), new).otherwise(value)

    return _let(_day(value), renew)


def ipv4(value: Column, key: str) -> Column:
    def renew(o: Column) -> Column:
        half = lambda i: o[i] * 256 + o[i + 1]
        new = _feistel(half(0), half(2), F.lit(65536), F.lit(65536), key, "ipv4")
        shown = _let(new, lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))))
        return F.when(F.forall(o, lambda x: x <= 255), shown).otherwise(value)

    return _let(F.transform(F.split(value, "\\."), lambda x: x.cast("int")), renew)


def email(value: Column, key: str) -> Column:
    """Marks in front of the address stay."""
    head = F.regexp_extract(value, "^[._%+-]*", 0)
    address = F.lower(F.regexp_replace(value, "^[._%+-]*", ""))
    return F.concat(head, F.lit("user."), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), address), 256), 1, 16), F.lit("@example.com"))


def secret(value: Column, key: str) -> Column:
    """The name and the quotes stay; the rest becomes a digest of the same length."""
    head = F.regexp_extract(value, "^[^=:]*[=:][ ]{0,3}[\"']?(?:(?i:bearer)[ ])?", 0)
    tail = F.regexp_extract(value, "[\"']?$", 0)

    def hidden(body: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), body), 256)
        return F.substring(F.repeat(digest, (F.length(body) / 64 + 1).cast("int")), F.lit(1), F.length(body))

    return _let(F.struct(head.alias("h"), tail.alias("t")), lambda x: F.concat(x["h"], _let(F.substring(value, F.length(x["h"]) + 1, F.length(value) - F.length(x["h"]) - F.length(x["t"])), hidden), x["t"]))


MAKERS = {"email": email, "secret": secret, "iban": iban, "phone": phone, "date": date, "ssn": ssn, "ipv4": ipv4, "card": card}


#: Whether a value of the right shape is one; shapes that aren't here always are.
CHECKS = {
    "date": lambda v: _day(v).isNotNull(),
    "ssn": lambda v: _ssn_digits(_digits(v)),
    "ipv4": lambda v: F.forall(F.split(v, "\\."), lambda x: x.cast("int") <= 255),
}


def kind_of(value: Column, kinds: tuple[str, ...]) -> Column:
    """The first of kinds whose whole pattern value matches."""
    found = F.lit(kinds[-1])
    for name in reversed(kinds[:-1]):
        found = F.when(value.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(found)
    return found


def _by_kind(kind: Column, of: dict[str, Column], rest: Column) -> Column:
    for name, result in of.items():
        rest = F.when(kind == name, result).otherwise(rest)
    return rest


def _replaced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with change(match) for each match of pattern."""

    def joined(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), found, lambda g, v: F.concat(g, change(v))), ""), F.element_at(gaps, -1))

    return F.when(text.rlike(pattern), _let(F.split(text, pattern, -1), joined)).otherwise(text)


def _parts_marked(run: Column, token: str, most: int, valid: Callable[[Column], Column], mark: Column) -> Column:
    """run with mark around its valid parts of up to `most` tokens.

    A part that meets a longer one which begins later gives way to it.
    """

    def marked(tokens: Column) -> Column:
        n = F.size(tokens)
        part = lambda i, k: F.regexp_replace(F.array_join(F.slice(tokens, i, k), ""), "^[ -]", "")
        longest = lambda i: F.get(F.filter(F.sequence(F.least(F.lit(most), n - i + 1), F.lit(1), F.lit(-1)), lambda k: valid(part(i, k))), F.lit(0))
        spans = F.transform(F.sequence(F.lit(1), n), lambda i: _let(longest(i), lambda k: F.struct(k.alias("k"), F.length(F.regexp_replace(part(i, F.coalesce(k, F.lit(0))), "[ -]", "")).alias("size"))))

        def cut(spans: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                at = F.get(spans, i - 1)
                beaten = F.exists(F.slice(spans, i + 1, F.greatest(at["k"] - 1, F.lit(0))), lambda x: x["k"].isNotNull() & (x["size"] > at["size"]))
                take = (i >= acc["next"]) & at["k"].isNotNull() & ~F.coalesce(beaten, F.lit(False))
                before = F.array_join(F.slice(tokens, acc["next"], F.greatest(i - acc["next"], F.lit(0))), "")
                first = F.get(tokens, i - 1)
                new = F.concat(before, F.regexp_extract(first, "^[ -]?", 0), mark, part(i, at["k"]), mark)
                return F.struct(F.when(take, F.array_append(acc["out"], new)).otherwise(acc["out"]).alias("out"), F.when(take, i + at["k"]).otherwise(acc["next"]).alias("next"))

            start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"))
            return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.array_join(F.slice(tokens, acc["next"], n), "")))

        return _let(spans, cut)

    return _let(F.regexp_extract_all(run, F.lit(token), F.lit(0)), marked)


def _marked(text: Column, kinds: tuple[str, ...], mark: Column) -> Column:
    """text with mark before and after each valid value."""
    around = lambda v: F.concat(mark, v, mark)
    if kinds == ("iban",):
        valid = lambda v: v.rlike(f"^(?:{IBAN})$") & _let(F.regexp_replace(v, " ", ""), _iban_letters)
        return _replaced(text, IBAN_RUN, lambda run: _parts_marked(run, "[ ]?[A-Z0-9]+", 9, valid, mark))
    if kinds == ("card",):
        whole = lambda v: _let(_digits(v), _card_digits)
        part = lambda v: v.rlike("^(?:[0-9]{3,}[ -])*[0-9]+$") & whole(v)
        return _replaced(text, CARD_RUN, lambda run: F.when(whole(run), around(run)).otherwise(_parts_marked(run, "[ -]?[0-9]+", 7, part, mark)))

    def checked(v: Column) -> Column:
        return F.when(_by_kind(kind_of(v, kinds), {k: CHECKS[k](v) for k in kinds if k in CHECKS}, F.lit(True)), around(v)).otherwise(v)

    return _replaced(text, "|".join(KINDS[k] for k in kinds), checked)


def _values(text: Column, kinds: tuple[str, ...], mark: Column, key: str) -> Column:
    """text as an array of (kind, value, pseudonym), kind null for what is no value."""

    def one(v: Column, i: Column) -> Column:
        new = _let(kind_of(v, kinds), lambda k: F.struct(k.alias("kind"), v.alias("value"), _by_kind(k, {x: MAKERS[x](v, key) for x in kinds}, v).alias("pseudonym")))
        return F.when(i % 2 == 1, new).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), v.alias("value"), v.alias("pseudonym")))

    return F.transform(F.split(_marked(text, kinds, mark), mark, -1), one)


def with_pseudonyms(docs: DataFrame, text: str = "text", key: str | None = None, name: str = "pii") -> DataFrame:
    """docs with text replaced, and an array of (kind, value, pseudonym) in text order, under a free name.

    A text without a digit, @, = or : skips the search. What fails its check isn't listed.
    """
    key = key or key_of(docs)
    pii_, mark_ = (free(docs.columns, x) for x in ("pii_", "mark_"))
    value = F.col(f"`{text}`")
    # no text holds its own digest; its digits become letters, so that it is neither a number nor a pattern
    mark = F.concat(F.lit("\u0001"), F.translate(F.md5(value), "0123456789", "ghijklmnop"))
    out = docs.withColumn(mark_, mark)
    found = F.when(value.rlike("[0-9@=:]"), F.array(F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value"), value.alias("pseudonym"))))
    out = out.withColumn(pii_, found)
    searched = lambda kinds: lambda x: F.when(x["kind"].isNotNull(), F.array(x)).otherwise(_values(x["value"], kinds, F.col(mark_), key))
    for kinds in PASSES:
        out = out.withColumn(pii_, F.flatten(F.transform(pii_, searched(kinds))))
    new = F.when(F.size(pii_) > 1, F.array_join(F.transform(pii_, lambda x: x["pseudonym"]), "")).otherwise(value)
    shown = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*shown, F.coalesce(F.filter(pii_, lambda x: x["kind"].isNotNull()), F.array().cast(out.schema[pii_].dataType)).alias(name))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    name = free(docs.columns, "pii")
    return with_pseudonyms(docs, text, key, name).drop(name)


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, the new text, and how many values of each kind were replaced."""
    out = with_pseudonyms(docs.select("doc_id", "text"))
    changed = F.filter("pii", lambda p: p["value"] != p["pseudonym"])
    of = F.transform(changed, lambda p: p["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", F.size(changed).cast("long").alias("n_replaced"), *counts)
