"""Validators and confidence as Columns: they run inside codegen on exploded candidates."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.lexicon import ADDRESS_ENDS, CONTEXT_WORDS, COUNTRIES, DENY, PENALISED


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    """Characters of a string that isn't empty."""
    return F.split(x, "")


def _weighted(x: Column, weights: tuple[int, ...]) -> Column:
    """Sum of a digit string's digits times weights."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.substring(x, i + 1, 1).try_cast("int"), F.lit(0)) * w for i, w in enumerate(weights)))


def ipv4(x: Column) -> Column:
    parts = F.split(x, "\\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$") & (p.try_cast("int") <= 255))


def luhn(x: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", x), F.lit(False))


def card_format(x: Column) -> Column:
    """Digits whose length and first digits are those of a card network."""
    n = F.length(x)
    four, three = F.substring(x, 1, 4).try_cast("int"), F.substring(x, 1, 3).try_cast("int")
    known = x.rlike("^(?:4|34|37|5[1-5]|6011|65|30|36|38)") | four.between(2221, 2720) | three.between(644, 649)
    return n.between(13, 19) & F.coalesce(known, F.lit(False))


def credit_card(x: Column) -> Column:
    d = digits(x)
    return F.length(d).between(13, 19) & (luhn(d) | card_format(d))


def _compact(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, "[^\\p{L}\\p{N}]", ""))


def iban_shape(x: Column) -> Column:
    return _compact(x).rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")


def iban_strict(x: Column) -> Column:
    """Letters count from 10; the whole number, country and check digits last, is 1 modulo 97."""
    c = _compact(x)
    turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    step = lambda a, ch: F.when(ch.rlike("[0-9]"), (a * 10 + ch.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)
    rest = F.aggregate(F.filter(_chars(turned), lambda ch: ch != ""), F.lit(0), step)
    return iban_shape(x) & (rest == 1)


def ssn(x: Column) -> Column:
    """Nine digits with an area, group and serial that are given out."""
    return x.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def ssn_area(x: Column) -> Column:
    return ~digits(x).rlike("^(?:000|666|9)")


def aba_routing(x: Column) -> Column:
    return x.rlike("^[0-9]{9}$") & (_weighted(x, (3, 7, 1) * 3) % 10 == 0)


def vin(x: Column) -> Column:
    """Check digit in ninth place; letters stand for digits."""
    plain = F.translate(x, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    rest = _weighted(plain, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)) % 11
    return x.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(x, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string")))


#: The dihedral group's table and the permutation of the Verhoeff check.
DIHEDRAL = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
PERMUTED = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")


def verhoeff(x: Column) -> Column:
    table, turned = F.lit("".join(DIHEDRAL)), F.lit("".join(PERMUTED))
    at = lambda s, i: F.substring(s, i + 1, 1).try_cast("int")
    numbered = F.transform(_chars(F.reverse(x)), lambda ch, i: at(turned, (i % 8) * 10 + F.coalesce(ch.try_cast("int"), F.lit(0))))
    return F.aggregate(numbered, F.lit(0), lambda c, p: at(table, c * 10 + p)) == 0


def aadhaar(x: Column) -> Column:
    d = digits(x)
    return (F.length(d) == 12) & verhoeff(d)


def npi(x: Column) -> Column:
    return x.rlike("^[0-9]{10}$") & luhn(F.concat(F.lit("80840"), x))


def dea(x: Column) -> Column:
    d = F.substring(x, 3, 7)
    return x.rlike("^[A-Za-z]{2}[0-9]{7}$") & (_weighted(d, (1, 2, 1, 2, 1, 2)) % 10 == F.substring(d, 7, 1).try_cast("int"))


def phone(x: Column) -> Column:
    """At least seven digits, no date, version or run of one digit, and in America an area code that is given out."""
    d = digits(x)
    local = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    odd = F.trim(x).rlike(r"^(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|v?\d+\.\d+\.\d+|\d{5}-\d{4}|0{3,}|1{3,}|(\d)\1{6,}|123456\d*)$")
    dull = F.size(F.array_distinct(F.filter(_chars(d), lambda c: c != ""))) <= 2
    closed = (F.length(local) == 10) & local.rlike("^(?:[01]|[2-9]11|000|100|200|...0)")
    return (F.length(d) >= 7) & ~odd & ~dull & ~closed


def uk_ni(x: Column) -> Column:
    c = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    return c.rlike("^(?!BG|GB|KN|NK|NR|TN|ZZ)[A-Z&&[^DFIQUV]][A-Z&&[^DFIQUVO]][0-9]{6}[A-D]$")


def date_iso(x: Column) -> Column:
    return F.substring(x, 6, 2).try_cast("int").between(1, 12) & F.substring(x, 9, 2).try_cast("int").between(1, 31)


def gps(x: Column) -> Column:
    pair = F.split(x, "[,/]")
    return F.get(pair, F.lit(0)).try_cast("double").between(-90, 90) & F.get(pair, F.lit(1)).try_cast("double").between(-180, 180)


def age(x: Column) -> Column:
    return F.regexp_extract(x, "([0-9]{1,3})", 1).try_cast("int").between(0, 150)


def _table(lists: dict[str, list[str]]) -> Column:
    """A constant map from a type to its words."""
    return F.from_json(F.lit(json.dumps(lists)), "map<string,array<string>>")


def has_context(kind: Column, window: Column) -> Column:
    """Whether a word that backs up the type stands in the window (words of Latin letters only)."""
    found = F.regexp_extract_all(F.lower(window), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))
    words = F.try_element_at(_table({k: v.split() for k, v in CONTEXT_WORDS.items()}), kind)
    return F.coalesce(F.arrays_overlap(found, words), F.lit(False))


def swift(x: Column, window: Column) -> Column:
    return F.substring(x, 5, 2).isin(*COUNTRIES.split()) & has_context(F.lit("IBAN"), window)


def adjusted(base: Column, kind: Column, window: Column, boost: float = 0.10, penalty: float = 0.15, cap: float = 0.99, floor: float = 0.40) -> Column:
    """Confidence with its context's boost or penalty; ``kind`` null: no adjustment."""
    near = has_context(kind, window)
    return (
        F.when(kind.isNull(), base)
        .when(near, F.least(base + boost, F.lit(cap)))
        .when(kind.isin(*PENALISED), F.greatest(base - penalty, F.lit(floor)))
        .otherwise(base)
    )


def listed(kind: Column, text: Column, lists: dict[str, str] = DENY) -> Column:
    """Whether the lower-cased phrase is on its type's list."""
    phrases = F.try_element_at(_table({k: v.split("|") for k, v in lists.items()}), kind)
    return F.coalesce(F.array_contains(phrases, F.lower(text)), F.lit(False))


def address_phrase(text: Column, before: Column) -> Column:
    """Two words or more that end like a street, or a digit right before."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    last = F.lower(F.try_element_at(words, F.lit(-1)))
    return ((F.size(words) >= 2) & F.coalesce(last.isin(*ADDRESS_ENDS.split()), F.lit(False))) | before.rlike("[0-9]$")


#: Validators that say yes or no.
PLAIN = {"ipv4": ipv4, "aba_routing": aba_routing, "vin": vin, "npi": npi, "uk_ni": uk_ni, "dea": dea, "phone": phone, "ssn_dash": ssn_area, "ssn_space": ssn_area, "ssn_nodash": ssn, "date_iso": date_iso, "gps": gps, "age": age}


def validated(validator: Column, base: Column, valid: Column, invalid: Column, text: Column, window: Column) -> Column:
    """Confidence after the validator; null: the match is none."""
    d = digits(text)
    tier = lambda ok: F.when(ok, F.coalesce(valid, base)).otherwise(invalid)
    out = F.when(validator.isNull(), base)
    out = out.when(validator == "credit_card", F.when(~F.length(d).between(13, 19), None).when(luhn(d), 0.94).when(card_format(d), 0.80))
    out = out.when(validator == "iban", F.when(iban_strict(text), 0.93).when(iban_shape(text), 0.78))
    out = out.when(validator == "sin_luhn", F.when(F.length(d) == 9, tier(luhn(d))))
    out = out.when(validator == "aadhaar", F.when(F.length(d) == 12, tier(verhoeff(d))))
    out = out.when(validator == "swift_context", F.when(swift(text, window), base))
    for name, check in PLAIN.items():
        out = out.when(validator == name, tier(F.coalesce(check(text), F.lit(False))))
    return out
