"""Detection.

``detect`` runs every pattern of the registry in one Arrow pass over the texts - Python's
regular expressions, so offsets count code points - and gives candidates with a window of their
surroundings; validators, context, deny and allow lists are Columns on the candidates.

``native_spans`` finds one pattern without leaving the JVM: matches and the gaps between them
give the offsets.  It serves patterns that mean the same to Java.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions.lexicon import DENY
from veilspark.functions.patterns import REGISTRY, SUPPORTED, Spec

WINDOW = 50
CANDIDATES = "spec int, span_start int, span_end int, matched string, whole string, context string"
#: One row a finding.
FINDING = "doc_id bigint, field_path string, entity_type string, span_start int, span_end int, matched string, confidence double, engine_id string, language string"


#: Words of which a text must hold one (case aside) before the patterns of a type, or those of its
#: patterns that mention the marker after the colon, can match it.
GUARDS = {
    "DRIVERS_LICENSE": "licen|permis|hrerschein|dl-", "PASSPORT": "passport", "ROUTING_NUMBER": "routing|aba|transit", "LICENSE_PLATE": "plate|tag|vehicle|license|reg",
    "CREDIT_CARD_FRAGMENT": "card", "BANK_ACCOUNT": "account|acct|bank", "NATIONAL_ID": "id", "EMPLOYEE_ID": "emp|staff|personnel|badge", "MEDICAL_RECORD_NUMBER": "mrn|medical|patient|health",
    "ZIP_CODE": "zip|postal", "CANADIAN_SIN": "sin|social", "API_KEY": "api|bearer|access|secret", "AADHAAR": "aadha|uid", "AGE": "age|year", "MEDICAL_LICENSE": "npi|national|dea",
    "DATE_OF_BIRTH": "born|dob|birth|d.o.b|nacimiento", "CVV": "cvv|cvc|cid|security|card", "PIN": "pin|passcode", "PASSWORD": "pass|pwd", "COURT_CASE_NUMBER": "case|no.", "DOCKET_NUMBER": "docket",
    "BAR_NUMBER": "bar|sbn", "INVOICE_NUMBER": "inv", "INSURANCE_POLICY_NUMBER": "policy", "SALARY": "salary|compensation|pay|earnings|wage", "CRYPTO_WALLET:bc1": "bc1",
    "USERNAME:handle": "user|login|handle|screen", "LOCATION:near": "near", "LOCATION:Addr": "addr:", "PERSON_NAME:alias": "alias|called|named|refer", "PERSON_NAME:'s": "'s", "PERSON_NAME:\\[(": "[", "PERSON_NAME:call": "call",
    "ORGANIZATION:Unternehmen": "company|organi|employe|unternehmen|empresa|entreprise|azienda|bedrijf|företag|virksomhed|firma|yritys|work|affiliated|belong",
}
#: Types whose every pattern asks for a digit.
WITH_DIGIT = {
    "US_SSN", "CREDIT_CARD", "IBAN", "PHONE_NUMBER", "DATE_OF_BIRTH", "DATE_ISO", "DATE_TIME", "DRIVERS_LICENSE", "ROUTING_NUMBER", "CREDIT_CARD_FRAGMENT", "BANK_ACCOUNT", "EMPLOYEE_ID", "ADDRESS",
    "GPS_COORDINATES", "ZIP_CODE", "CANADIAN_SIN", "UK_NI_NUMBER", "AADHAAR", "AGE", "MEDICAL_LICENSE", "CVV", "PIN", "COURT_CASE_NUMBER", "DOCKET_NUMBER", "BAR_NUMBER", "INVOICE_NUMBER", "INSURANCE_POLICY_NUMBER", "SALARY",
}
_DIGIT = re.compile(r"\d")


def _guard(s: Spec) -> list[str]:
    for name, words in GUARDS.items():
        kind, _, marker = name.partition(":")
        if kind == s.entity_type and marker in s.pattern:
            return words.split("|")
    return []


#: Where matches can start, by the characters that they can start with: (the characters, the places).  Each pattern
#: of places begins with a set, which is looked for far faster than a word's edge.
PLACES = {
    "upper": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), re.compile("[A-Z](?<![A-Za-z][A-Z])")), "digit": (frozenset("0123456789"), re.compile(r"\d(?<!\d\d)")),
    "upper or digit": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), re.compile(r"[A-Z\d](?<![A-Za-z][A-Z])(?<!\d\d)")), "number": (frozenset("+-(0123456789"), re.compile(r"[-+(\d](?<!\d\d)")),
}
#: What a pattern must begin with for these places to hold all its matches.
EDGES = {"\\b": PLACES, "(?<!\\w)": PLACES, "(?<![A-Za-z])": ("upper",), "(?<![0-9.])": ("digit", "number")}


def _first(tree, flags: int) -> tuple[frozenset[str] | None, bool]:
    """The characters that a parsed pattern's matches can start with (None: not known), and whether it can match nothing."""
    known: frozenset[str] = frozenset()
    for op, value in tree:
        name, empty = str(op), False
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            some = frozenset(chr(value))
        elif name == "IN":
            some = frozenset()
            for kind, x in value:
                part = {"LITERAL": lambda x=x: chr(x), "RANGE": lambda x=x: map(chr, range(x[0], x[1] + 1)), "CATEGORY": lambda x=x: "0123456789" if str(x) == "CATEGORY_DIGIT" else None}.get(str(kind), lambda: None)()
                if part is None:
                    return None, False
                some |= frozenset(part)
        elif name == "SUBPATTERN":
            some, empty = _first(value[3], flags | value[1])
        elif name == "BRANCH":
            parts = [_first(x, flags) for x in value[1]]
            some, empty = None if any(p is None for p, _ in parts) else frozenset().union(*[p for p, _ in parts]), any(e for _, e in parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            some, empty = _first(value[2], flags)
            empty = empty or value[0] == 0
        else:
            return None, False
        if some is None or (flags & re.IGNORECASE and any(c.lower() != c.upper() for c in some)):
            return None, False
        known |= some
        if not empty:
            return known, False
    return known, True


def places(s: Spec) -> str | None:
    """The kind of places where all matches of a pattern start, if there is one."""
    kinds = next((k for edge, k in EDGES.items() if s.pattern.startswith(edge)), ())
    tree = re._parser.parse(s.pattern, s.flags)
    known, empty = _first(tree, s.flags)
    return None if known is None or empty or str(tree[0][0]) == "BRANCH" else next((k for k in kinds if known <= PLACES[k][0]), None)


def _matches(rx: re.Pattern, text: str, starts: Sequence[int]) -> Iterator[re.Match]:
    """What ``rx.finditer(text)`` gives if all matches start at these places."""
    end = 0
    for a in starts:
        if a >= end and (m := rx.match(text, a)):
            yield m
            end = m.end()


def _scan(batches: Iterator[pa.RecordBatch], specs: Sequence[tuple[int, Spec]]) -> Iterator[pa.RecordBatch]:
    """Candidates of a batch of (id, field, lang, text)."""
    compiled = [(k, re.compile(s.pattern, s.flags), s, s.entity_type in WITH_DIGIT, _guard(s), places(s)) for k, s in specs]
    for b in batches:
        at, rows = [], []
        for i, (lang, text) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            lang, text = lang.as_py(), text.as_py()
            if not text:
                continue
            low, digit = text.casefold().replace("ı", "i").replace("i̇", "i"), bool(_DIGIT.search(text))
            starts = {}
            for k, rx, s, counted, words, where in compiled:
                if (counted and not digit) or (s.needs and s.needs not in text) or (s.language and s.language != lang) or (words and not any(w in low for w in words)):
                    continue
                if where and where not in starts:
                    starts[where] = [m.start() for m in PLACES[where][1].finditer(text)]
                for m in _matches(rx, text, starts[where]) if where else rx.finditer(text):
                    a, z = m.span(s.group)
                    if a < z:
                        at.append(i)
                        rows.append((k, a, z, text[a:z], m.group(0), text[max(0, a - WINDOW) : z + WINDOW]))
        take = pa.array(at, pa.int64())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(3)] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "field_path", "language", *[x.split()[0] for x in CANDIDATES.split(", ")]])


def candidates(texts: DataFrame, types: Sequence[str] | None = None, registry: Sequence[Spec] = REGISTRY, partitions: int | None = None) -> DataFrame:
    """Every match of the patterns, before any validator or list: (doc_id, field_path, language, spec, span_start, span_end, matched, whole, context).

    ``partitions`` deals the texts anew, for small tables whose few files would keep most cores idle.
    """
    specs = [(k, s) for k, s in enumerate(registry) if types is None or s.entity_type in types]
    kind = texts.schema["doc_id"].dataType.simpleString()
    src = texts.select("doc_id", "field_path", "language", "text")
    src = src.repartition(partitions) if partitions else src
    return src.mapInArrow(lambda it: _scan(it, specs), f"doc_id {kind}, field_path string, language string, {CANDIDATES}")


def detect(
    texts: DataFrame, types: Sequence[str] | None = SUPPORTED, allow: dict[str, str] | None = None, deny: dict[str, str] = DENY, min_confidence: float = 0.5,
    engine_id: str = "regex", registry: Sequence[Spec] = REGISTRY, partitions: int | None = None,
) -> DataFrame:
    """Findings of (doc_id, field_path, language, text); all overlapping ones are given.

    The type filter picks patterns before the scan.  A null or empty text has no findings; a
    null language meets the patterns of no language only.
    """
    specs = [(k, s) for k, s in enumerate(registry) if types is None or s.entity_type in types]
    found = candidates(texts, types, registry, partitions)
    # The numbers of patterns are few: their properties come from a table of them.
    keys = texts.sparkSession.createDataFrame(
        [(k, s.entity_type, s.validator, s.context, s.base, *s.tiers, s.deny, s.group == 0) for k, s in specs],
        "spec int, entity_type string, validator string, near string, base double, valid double, invalid double, denies boolean, whole_match boolean",
    )
    before = F.when(F.col("span_start") > 0, F.expr(f"substring(context, least(span_start, {WINDOW}), 1)")).otherwise("")
    name, text, window = F.col("entity_type"), F.col("matched"), F.col("context")
    keep = ~((name == "PERSON_NAME") & F.col("whole_match") & checks.address_phrase(text, before)) & ~(F.col("denies") & checks.listed(name, text, deny))
    if allow:
        keep = keep & ~checks.listed(name, text, allow)
    checked = F.when(keep, checks.validated(F.col("validator"), F.col("base"), F.col("valid"), F.col("invalid"), text, window))
    # explode() keeps the validators from being copied into the filter and the confidence
    out = found.join(F.broadcast(keys), "spec").select("*", F.explode(F.array(checked)).alias("checked")).filter("checked is not null")
    out = out.select("*", F.explode(F.array(checks.adjusted(F.col("checked"), F.col("near"), window))).alias("confidence")).filter(F.col("confidence") >= min_confidence)
    return out.select("doc_id", "field_path", "entity_type", "span_start", "span_end", "matched", "confidence", F.lit(engine_id).alias("engine_id"), "language", F.col("spec").alias("ordinal"))


def native_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, matched) of a pattern's matches, in order."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("matched")))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
CARD = r"(?:[0-9][ -]?){12,18}[0-9]"
PHONE = r"\+1\s*\([0-9]{3}\)\s*[0-9]{3}[-.\s][0-9]{4}"


def native(docs: DataFrame, pattern: str, entity_type: str, needs: str | None = None) -> DataFrame:
    """(doc_id, entity_type, span_start, span_end, matched) of one pattern; the scan's filter is pushed down where a text needs a substring."""
    src = docs.filter(F.col("text").contains(needs)) if needs else docs
    spans = src.select("doc_id", "lang", F.explode(native_spans(F.col("text"), pattern)).alias("s"))
    return spans.select("doc_id", "lang", F.lit(entity_type).alias("entity_type"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.matched").alias("matched"))


def payload_texts(df: DataFrame, id_column: str, fields: Sequence[str] | None = None, language: Column | None = None) -> DataFrame:
    """String columns as rows (doc_id, field_path, language, text)."""
    fields = list(fields or [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name != id_column])
    lang = language if language is not None else F.lit("en")
    wide = df.select(F.col(id_column).alias("doc_id"), lang.alias("language"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(f).alias("field_path"), F.col(f"f{i}").alias("text")) for i, f in enumerate(fields)])
    return wide.select("doc_id", "language", F.explode(pairs).alias("p")).select("doc_id", "p.field_path", "language", "p.text")


def document_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit("text").alias("field_path"), F.col("lang").alias("language"), "text")
