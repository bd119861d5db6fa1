"""Transform strategies as Columns: placeholder, tokenize, redact, generalize, synthetic, perturb; policies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.lexicon import ALIASES, CITIES, HONORIFICS, NAMES, POLICIES, STREETS

MASK = "█"


def canonical(entity_type: Column) -> Column:
    """A detected type's name in policies and hierarchies."""
    pairs = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    return F.coalesce(F.try_element_at(pairs, entity_type), entity_type)


def stars(n: Column, mark: str = "*") -> Column:
    return F.repeat(F.lit(mark), F.greatest(n, F.lit(0)).cast("int"))


# placeholder and redaction ---------------------------------------------------------------


def placeholder(entity_type: Column, index: Column, template: str = "<{entity_type}:anon_{index}>", cluster: Column | None = None) -> Column:
    out = F.replace(F.lit(template), F.lit("{entity_type}"), entity_type)
    out = F.replace(out, F.lit("{index}"), index.cast("string"))
    return F.replace(out, F.lit("{cluster_id}"), F.coalesce(cluster, F.lit("")) if cluster is not None else F.lit(""))


def redact(x: Column, mode: str = "full", mark: str = MASK, reveal: int = 2, compat: bool = False) -> Column:
    """``compat``: texts no longer than what is revealed stay as they are; else they are masked whole."""
    n = F.length(x)
    whole = stars(n, mark)
    if mode == "length_preserving":
        return F.regexp_replace(x, "[\\p{L}\\p{N}]", mark)
    if mode in ("partial_start", "partial_end"):
        shown = F.concat(F.substring(x, 1, reveal), stars(n - reveal, mark)) if mode == "partial_start" else F.concat(stars(n - reveal, mark), x.substr(n - reveal + 1, F.lit(reveal)))
        return F.when(n > reveal, shown).otherwise(x if compat else whole)
    return whole


# generalisation --------------------------------------------------------------------------


def thousands(n: Column) -> Column:
    return F.regexp_replace(n.cast("string"), "(?<=\\d)(?=(?:\\d{3})+$)", ",")


def numeric_range(x: Column, bucket: int = 10, prefix: str = "", separated: bool = False) -> Column:
    v = F.regexp_replace(x, "[^0-9.\\-]", "").try_cast("double")
    low = (F.floor(v / bucket) * bucket).cast("bigint")
    show = (lambda n: F.concat(F.lit(prefix), thousands(n))) if separated else (lambda n: F.concat(F.lit(prefix), n.cast("string")))
    return F.when(v.isNull(), "[GENERALIZED]").otherwise(F.concat(show(low), F.lit("-"), show(low + bucket - 1)))


def date_year(x: Column) -> Column:
    year = F.regexp_extract(x, "([0-9]{4})", 1)
    return F.when(year == "", "[YEAR]").otherwise(year)


def prefix_mask(x: Column, keep: int = 3, mark: str = "*") -> Column:
    return F.concat(F.substring(x, 1, max(keep, 0)), stars(F.length(x) - max(keep, 0), mark))


def partial_mask(x: Column, start: int = 0, end: int = 0, mark: str = "*") -> Column:
    n = F.length(x)
    tail = x.substr(F.greatest(n - end + 1, F.lit(1)), F.lit(end)) if end else F.lit("")
    return F.concat(F.substring(x, 1, start) if start else F.lit(""), stars(n - start - end, mark), tail)


def email_mask(x: Column) -> Column:
    at = F.instr(x, "@")
    return F.when(at <= 1, "***@[DOMAIN]").otherwise(F.concat(F.substring(x, 1, 1), F.lit("***"), x.substr(at, F.length(x))))


def initials(x: Column) -> Column:
    parts = F.filter(F.split(x, "\\s+"), lambda p: p != "")
    one = lambda p: (
        F.when(F.lower(F.regexp_replace(p, "[.,]+$", "")).isin(*HONORIFICS.split()), p)
        .when(p.rlike("^\\p{L}"), F.concat(F.upper(F.substring(p, 1, 1)), F.lit(".")))
        .otherwise(p)
    )
    return F.when(F.size(parts) == 0, "[NAME]").otherwise(F.array_join(F.transform(parts, one), " "))


def truncate_precision(x: Column, places: int = 1) -> Column:
    """Every number to so many places; separators stay."""
    numbers, gaps = F.filter(F.split(x, "[,\\s]+"), lambda p: p != ""), F.split(x, "[^,\\s]+", -1)
    shown = F.transform(numbers, lambda p: F.when(p.try_cast("double").isNotNull(), F.format_string(f"%.{places}f", p.try_cast("double"))).otherwise(p))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), shown.alias("n")), lambda z: F.array(z["g"], F.coalesce(z["n"], F.lit(""))))), "")


def subnet(x: Column) -> Column:
    parts = F.split(x, "\\.")
    return F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0/24"))).otherwise(x)


def generic(x: Column) -> Column:
    return F.when(F.length(x) <= 1, "*").otherwise(F.concat(F.substring(x, 1, 1), stars(F.length(x) - 1)))


#: How each type loses precision.
HIERARCHIES: dict[str, Callable[[Column], Column]] = {
    "AGE": lambda x: numeric_range(x, 10),
    "SALARY": lambda x: numeric_range(x, 10_000, "$", True),
    "DATE_OF_BIRTH": date_year,
    "DATE": date_year,
    "ZIP_CODE": lambda x: prefix_mask(x, 3),
    "ADDRESS": lambda x: prefix_mask(x, 0),
    "PHONE_NUMBER": lambda x: partial_mask(x, 4, 0),
    "EMAIL_ADDRESS": email_mask,
    "PERSON_NAME": initials,
    "LOCATION_COORDINATES": truncate_precision,
    "IP_ADDRESS": subnet,
    "CREDIT_CARD_NUMBER": lambda x: partial_mask(x, 0, 4),
}


def generalize(entity_type: Column, x: Column) -> Column:
    t, out = canonical(entity_type), generic(x)
    for name, f in HIERARCHIES.items():
        out = F.when(t == name, f(x)).otherwise(out)
    return out


# tokens ----------------------------------------------------------------------------------


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in raw), bytes(x ^ 0x5C for x in raw)


def hmac_sha256(key: str, message: Column) -> Column:
    """Binary HMAC.  The key's pads are literals of the plan: don't show plans of keyed jobs."""
    inner, outer = _pads(key)
    return F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256))), 256))


def token(entity_type: Column, x: Column, key: str, scope: Column, version: int = 1) -> Column:
    h = hmac_sha256(key, F.concat_ws("|", scope, F.lit(f"v{version}"), entity_type, x))
    body = F.translate(F.base64(F.substring(h, 1, 18)), "+/", "-_")
    return F.concat(F.lit("<"), entity_type, F.lit(f":v{version}:tok_"), body, F.lit(">"))


# synthetic -------------------------------------------------------------------------------


def seed(key: str, scope: Column, x: Column) -> Column:
    """First 64 bits of the HMAC, unsigned."""
    h = hmac_sha256(key, F.concat_ws("|", F.lit(key), scope, x))
    return F.conv(F.hex(F.substring(h, 1, 8)), 16, 10).cast("decimal(20,0)")


def _signed(s: Column) -> Column:
    """A seed less 2^63 as a bigint, which is worked with far faster than a decimal."""
    return (s - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")


def _mod(s: Column, n: int | Column, bits: int = 0) -> Column:
    """What is left of a seed, moved by so many bits, by n."""
    n = n if isinstance(n, Column) else F.lit(n).cast("bigint")
    return F.pmod(F.pmod(F.shiftright(_signed(s), bits) if bits else _signed(s), n) + (F.lit(1 << 63 - bits) if bits else F.pmod(F.lit((1 << 63) - 1), n) + 1) % n, n)


def _pick(words: list[str], s: Column, bits: int = 0) -> Column:
    return F.get(F.array(*map(F.lit, words)), _mod(s, len(words), bits).cast("int"))


def _by_language(language: Column, make: Callable[[str], Column]) -> Column:
    out = make("en")
    for lang in NAMES:
        out = F.when(language == lang, make(lang)).otherwise(out)
    return out


def _first(language: Column, s: Column) -> Column:
    return _by_language(language, lambda k: _pick(NAMES[k][0].split(), s))


def _last(language: Column, s: Column) -> Column:
    return _by_language(language, lambda k: _pick(NAMES[k][1].split(), s, 16))


def synthetic_name(x: Column, language: Column, s: Column) -> Column:
    parts = F.filter(F.split(x, "\\s+"), lambda p: p != "")
    head, both = F.try_element_at(parts, F.lit(1)), F.concat(_first(language, s), F.lit(" "), _last(language, s))
    titled = F.lower(F.regexp_replace(head, "[.,]+$", "")).isin(*HONORIFICS.split())
    return F.when(titled, F.concat(head, F.lit(" "), both)).when(F.size(parts) == 1, _first(language, s)).otherwise(both)


def synthetic_email(x: Column, language: Column, s: Column) -> Column:
    dot = F.when(F.substring_index(x, "@", 1).contains("."), ".").otherwise("")
    return F.concat(F.lower(_first(language, s)), dot, F.lower(_last(language, s)), F.lit("@"), _pick(["example.com", "example.org", "example.net"], s, 32))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _walked(s: Column, gain: int, n: int) -> Column:
    """The digits that a seed gives as it loses its last digit and gains ``gain``, n times: adding the gain to what is left is adding its tens before."""
    tens = F.lit(f"{gain}" * (n - 1) + "0").cast(f"decimal({n},0)")
    return F.substring(F.reverse(F.lpad((s + tens).cast("string"), 30, "0")), 1, n)


def _digit_walk(x: Column, s: Column) -> Column:
    """Each digit replaced by the seed's last; the seed then loses it and gains 7.  A seed of 20 digits has only sevens left after 26."""
    gaps = F.split(x, "[0-9]", -1)
    digits = F.rpad(_walked(s, 7, 26), F.size(gaps) - 1, F.lit("7"))
    return _once(digits, lambda d: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, d.substr(i + 1, F.lit(1)))), ""))


def synthetic_address(x: Column, language: Column, s: Column) -> Column:
    city = _by_language(language, lambda k: _pick(CITIES[k].split("|"), s))
    return F.concat((_mod(s, 9000) + 100).cast("string"), F.lit(" "), _pick(STREETS.split("|"), s, 16), F.lit(", "), city)


def synthetic_zip(x: Column, s: Column) -> Column:
    n = F.length(F.regexp_replace(x, "[^0-9]", ""))
    n = F.when(n <= 0, 5).otherwise(F.least(n, F.lit(18)))
    body = F.lpad(_mod(s, F.pow(F.lit(10), n).cast("bigint")).cast("string"), n, "0")
    first = F.length(F.regexp_replace(F.substring_index(x, "-", 1), "[^0-9]", ""))
    return F.when(x.contains("-"), F.concat(body.substr(F.lit(1), first), F.lit("-"), body.substr(first + 1, n))).otherwise(body)


def synthetic_card(s: Column) -> Column:
    """A number that passes the Luhn check: 4, the seed's last digit 14 times (it then loses it and gains 3), and the check digit of these."""
    twice = F.create_map(*[F.lit(x) for d in range(10) for x in (str(d), 2 * d - 9 * (d > 4))])

    def made(d: Column) -> Column:
        one = lambda k: F.try_element_at(twice, F.substring(d, k, 1)) if k % 2 else F.substring(d, k, 1).cast("int")
        total = one(1)
        for k in range(2, 16):
            total = total + one(k)
        return F.concat_ws("-", *[F.substring(d, 4 * k + 1, 4) for k in range(3)], F.concat(F.substring(d, 13, 3), F.pmod(-total, F.lit(10)).cast("string")))

    return _once(F.concat(F.lit("4"), _walked(s, 3, 14)), made)


def _date_parts(x: Column) -> Column:
    """(y, sep, m, d) of the first date in a text; null if it has none."""
    found = F.nullif(F.regexp_extract(x, "[0-9]{4}[^0-9][0-9]{1,2}[^0-9][0-9]{1,2}", 0), F.lit(""))
    n = lambda t: F.when(F.substring(t, 7, 1).between("0", "9"), 2).otherwise(1)  # noqa: E731  (digits of the month)
    part = lambda t: F.struct(F.substring(t, 1, 4).cast("int").alias("y"), F.substring(t, 5, 1).alias("sep"), t.substr(F.lit(6), n(t)).cast("int").alias("m"), t.substr(n(t) + 7, F.lit(2)).cast("int").alias("d"))
    return _once(found, lambda t: F.when(t.isNotNull(), part(t)))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def synthetic_date(x: Column, s: Column) -> Column:
    month = lambda p: F.greatest(F.lit(1), F.least(F.lit(12), p["m"] + _mod(s, 3, 8).cast("int")))
    day = lambda p: F.greatest(F.lit(1), F.least(F.lit(28), p["d"]))
    new = lambda p: F.concat((p["y"] + _mod(s, 5).cast("int") - 2).cast("string"), p["sep"], _two(month(p)), p["sep"], _two(day(p)))
    return _once(_date_parts(x), lambda p: F.when(p.isNull(), x).otherwise(new(p)))


def synthetic_generic(x: Column, s: Column) -> Column:
    return F.sha2(F.concat_ws("|", s.cast("string"), x).cast("binary"), 256).substr(F.lit(1), F.length(x))


def synthetic(entity_type: Column, x: Column, key: str, scope: Column, language: Column) -> Column:
    t, s = canonical(entity_type), seed(key, scope, x)
    out = synthetic_generic(x, s)
    made = {
        "PERSON_NAME": synthetic_name(x, language, s), "EMAIL_ADDRESS": synthetic_email(x, language, s), "PHONE_NUMBER": _digit_walk(x, s), "ADDRESS": synthetic_address(x, language, s),
        "ZIP_CODE": synthetic_zip(x, s), "CREDIT_CARD_NUMBER": synthetic_card(s), "DATE_OF_BIRTH": synthetic_date(x, s), "DATE": synthetic_date(x, s),
    }
    for name, c in made.items():
        out = F.when(t == name, c).otherwise(out)
    return out


# perturbation ----------------------------------------------------------------------------


def noise_seed(scope: Column, index: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", scope, index.cast("string"), x).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def laplace(s: Column, scale: float) -> Column:
    u = _mod(s, 1_000_000) / 1_000_000.0 - 0.5
    u = F.when(u == 0, 0.001).otherwise(u)
    return -scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def gaussian(s: Column, sigma: Column, bits: int = 0) -> Column:
    u1, u2 = (_mod(s, 1_000_000, bits) + 1) / 1_000_001.0, (_mod(s, 1_000_000, bits + 20) + 1) / 1_000_001.0
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-10)))) * F.cos(2 * F.pi() * u2) * sigma


def perturb_age(x: Column, s: Column, epsilon: float = 1.0) -> Column:
    v = F.regexp_replace(x, "[^0-9]", "").try_cast("int")
    new = F.greatest(F.lit(0), F.least(F.lit(120), F.rint(v + laplace(s, 1.0 / max(epsilon, 0.01))).cast("int")))
    return F.coalesce(new.cast("string"), x)


def perturb_salary(x: Column, s: Column, sigma: float = 0.1) -> Column:
    v = F.regexp_replace(x, "[^0-9.]", "").try_cast("double")
    n = F.rint(F.greatest(F.lit(0.0), F.bround(v + gaussian(s, sigma * v), 2))).cast("bigint")
    return F.when(v.isNull(), x).otherwise(F.concat(F.when(x.contains("$"), "$").otherwise(""), F.when(x.contains(","), thousands(n)).otherwise(n.cast("string"))))


def perturb_coordinates(x: Column, s: Column, sigma: float = 0.01) -> Column:
    parts = F.transform(F.regexp_extract_all(x, F.lit("-?\\d+\\.?\\d*"), F.lit(0)), lambda p: p.try_cast("double"))
    at = lambda k, bits, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.get(parts, F.lit(k)) + gaussian(s, F.lit(sigma), bits)))
    return F.when(F.size(parts) < 2, x).otherwise(F.format_string("%.4f,%.4f", at(0, 0, 90.0), at(1, 20, 180.0)))


def perturb_date(x: Column, s: Column) -> Column:
    """Up to 30 days to and fro, in months of 28 days."""
    days = lambda p: (p["y"] * 12 + p["m"] - 1) * 28 + p["d"] - 1 + _mod(s, 61).cast("int") - 30
    months = lambda n: F.call_function("div", n - F.pmod(n, F.lit(28)), F.lit(28))
    years = lambda k: F.call_function("div", k - F.pmod(k, F.lit(12)), F.lit(12))
    shown = lambda p, n: F.concat(years(months(n)).cast("string"), p["sep"], _two(F.pmod(months(n), F.lit(12)) + 1), p["sep"], _two(F.pmod(n, F.lit(28)) + 1))
    return _once(_date_parts(x), lambda p: F.when(p.isNull(), x).otherwise(_once(days(p), lambda n: shown(p, n))))


def perturb(entity_type: Column, x: Column, scope: Column, index: Column, epsilon: float = 1.0, sigma: float = 0.1) -> Column:
    """Repeats for the same scope, place and text, so it hides values but is no differential privacy."""
    t, s = canonical(entity_type), noise_seed(scope, index, x)
    return (
        F.when(t == "AGE", perturb_age(x, s, epsilon)).when(t == "SALARY", perturb_salary(x, s, sigma)).when(t == "LOCATION_COORDINATES", perturb_coordinates(x, s, sigma))
        .when(t.isin("DATE", "DATE_OF_BIRTH"), perturb_date(x, s)).otherwise(x)
    )


# policies --------------------------------------------------------------------------------


def policy(name: str) -> dict[str, str]:
    """Type -> strategy of a named policy."""
    if name not in POLICIES:
        raise ValueError(f"no policy {name!r}; there are {', '.join(sorted(POLICIES))}")
    return {t: strategy for strategy, types in POLICIES[name].items() for t in types.split()}


def merged(first: dict[str, str], second: dict[str, str]) -> dict[str, str]:
    """Both policies' rules; the second wins."""
    return first | second


def strategy_of(entity_type: Column, rules: dict[str, str], otherwise: str = "none") -> Column:
    """The strategy that a policy's rules name for a type: its rules are part of the plan, and nothing is joined."""
    out = F.lit(otherwise)
    for strategy in sorted(set(rules.values())):
        out = F.when(entity_type.isin(*[k for k, v in rules.items() if v == strategy]), strategy).otherwise(out)
    return out


def indexed(values: DataFrame, scope: str, value: str, entity_type: Column) -> DataFrame:
    """Distinct (scope, value) rows with a dense number in their scope and the placeholder of it."""
    from pyspark.sql import Window

    rows = values.select(scope, value).distinct().withColumn("idx", F.dense_rank().over(Window.partitionBy(scope).orderBy(value)).cast("bigint"))
    return rows.withColumn("placeholder", placeholder(entity_type, F.col("idx")))


def apply_policy(rules: dict[str, str], key: str = "default", scope: Column | None = None, language: Column | None = None, otherwise: str = "none"):
    """A replacement function for ``transform_texts`` that follows the rules."""
    scope, language = scope if scope is not None else F.lit("default"), language if language is not None else F.lit("en")
    made = {
        "redact": lambda t, x, i: redact(x), "generalize": lambda t, x, i: generalize(t, x), "tokenize": lambda t, x, i: token(t, x, key, scope),
        "synthetic": lambda t, x, i: synthetic(t, x, key, scope, language), "perturb": lambda t, x, i: perturb(t, x, scope, i), "placeholder": lambda t, x, i: placeholder(t, i), "none": lambda t, x, i: x,
    }

    def replacement(t: Column, x: Column, i: Column) -> Column:
        out = made[otherwise](t, x, i)
        name = canonical(t)
        for strategy in sorted(set(rules.values())):
            out = F.when(name.isin(*[k for k, v in rules.items() if v == strategy]), made[strategy](t, x, i)).otherwise(out)
        return out

    return replacement
