"""Utility that is left, and what can still be inferred, after anonymisation: Columns over rows (original, anonymised)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.metrics import clamp01, ngrams, safe_div

#: What a whole value of a type looks like.
SHAPES = {
    "EMAIL_ADDRESS": r"[^@]+@[^@]+\.[^@]+",
    "PHONE_NUMBER": r"[\d\s\-\(\)\+]{7,}",
    "CREDIT_CARD_NUMBER": r"[\d\s\-]{13,19}",
    "IP_ADDRESS": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "US_SSN": r"\d{3}[\-\s]?\d{2}[\-\s]?\d{4}",
    "DATE_OF_BIRTH": r"\d{4}[\-/]\d{2}[\-/]\d{2}|\d{2}[\-/]\d{2}[\-/]\d{4}",
    "IBAN": r"[A-Z]{2}\d{2}[\s]?[\dA-Z\s]{10,30}",
    "MAC_ADDRESS": r"([0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}",
}
#: Words that give an attribute away.
CLUES = {
    "gender": "he she his her him hers",
    "age": "elderly young teenager toddler infant retired senior youth youngster child adult aged",
    "date_of_birth": "elderly young teenager toddler infant retired senior youth youngster child adult aged",
}
NATIONS = (
    "american british french german spanish italian chinese japanese indian brazilian canadian australian mexico london paris tokyo mumbai russia usa uk europe asia africa".split()
)

#: Words of good and of bad mood.
POSITIVE = tuple("good great excellent amazing wonderful fantastic love beautiful perfect happy best awesome".split())
NEGATIVE = tuple("bad terrible awful horrible hate worst ugly sad angry poor disappointing fail broken".split())


def has_shape(entity_type: Column, value: Column) -> Column:
    """Whether a whole value looks like its type; null where no shape is known."""
    out = F.lit(None).cast("boolean")
    for kind, rx in SHAPES.items():
        out = F.when(entity_type == kind, F.trim(value).rlike(f"^(?:{rx})$")).otherwise(out)
    return out


def format_preservation(replacements: DataFrame) -> DataFrame:
    """Of (entity_type, original, replacement) whose original has its type's shape, the share whose replacement has it too."""
    a, b = has_shape(F.col("entity_type"), F.col("original")), has_shape(F.col("entity_type"), F.col("replacement"))
    c = replacements.agg(F.count_if(a).alias("checked"), F.count_if(a & b).alias("preserved"))
    return c.select("checked", "preserved", F.when(F.col("checked") > 0, F.col("preserved") / F.col("checked")).otherwise(1.0).alias("score"))


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the characters of its spans (an array of start, end)."""
    cut = lambda t, s: F.concat(t.substr(F.lit(1), s["start"]), t.substr(s["end"] + 1, F.greatest(F.length(t), F.lit(1))))
    return F.aggregate(F.sort_array(spans, asc=False), text, cut)


def ngram_preservation(original: Column, anonymised: Column, n: int = 3) -> Column:
    """Jaccard similarity of character n-grams; 1 where either text is empty or the first has none."""
    a, b = ngrams(original, n), ngrams(anonymised, n)
    same = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.length(original) == 0) | (F.length(anonymised) == 0) | (F.size(a) == 0), 1.0).otherwise(same)


def tradeoff(privacy: Column, utility: Column, alpha: float | None = None) -> Column:
    """A weighted mean of the two, or their harmonic mean."""
    return alpha * privacy + (1 - alpha) * utility if alpha is not None else safe_div(2 * privacy * utility, privacy + utility)


def sentences(text: Column) -> Column:
    """The parts between sentence marks that hold more than white space."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def structure_kept(original: Column, anonymised: Column) -> Column:
    """How alike numbers of sentences and paragraphs are."""
    part = lambda f: F.abs(f(original) - f(anonymised)) / F.greatest(f(original), f(anonymised), F.lit(1))
    return 1 - (part(lambda x: F.size(sentences(x))) + part(lambda x: F.size(F.split(x, "\n\n", -1)))) / 2


def length_kept(original: Column, anonymised: Column) -> Column:
    a, b = F.length(original), F.length(anonymised)
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1)))


def polarity(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """(positive - negative) over both, of listed words that stand in the text."""
    low = F.lower(text)
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    p, n = count(positive), count(negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def task_utility(original: Column, anonymised: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """Mean of sentiment, structure and length kept; 1 where either text is empty."""
    mood = 1 - F.abs(polarity(original, positive, negative) - polarity(anonymised, positive, negative))
    score = (mood + structure_kept(original, anonymised) + length_kept(original, anonymised)) / 3
    return F.when((F.length(original) == 0) | (F.length(anonymised) == 0), 1.0).otherwise(score)


def attribute_inferred(kind: Column, anonymised: Column) -> Column:
    """Whether words of an anonymised text give an attribute of that kind away."""
    low = F.lower(anonymised)
    words = F.split(low, r"\s+")
    out = F.lit(False)
    for name, clues in CLUES.items():
        out = F.when(kind == name, F.arrays_overlap(words, F.array(*map(F.lit, clues.split())))).otherwise(out)
    told = F.lit(False)
    for w in NATIONS:
        told = told | low.contains(w)
    return F.when(kind == "nationality", told).otherwise(out)


def reconstruction(masked: DataFrame, known: DataFrame) -> DataFrame:
    """(known tokens, found) of known (token) that still stand in some masked (text).

    The tokens are a set the attacker has, so few; every text is searched for all of them in one pass.
    """
    tokens = [r.token for r in known.select("token").filter("token is not null and token != ''").distinct().limit(100_001).collect()]
    if len(tokens) > 100_000:
        raise ValueError("at most 100,000 known tokens; match more by detokenize() or an n-gram join")
    hits = masked.select(F.explode(F.filter(F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>"), lambda t: F.col("text").contains(t))).alias("token")).distinct()
    return hits.agg(F.count("*").alias("found")).select(F.lit(len(tokens)).cast("bigint").alias("known"), "found", (F.col("found") / F.lit(float(max(len(tokens), 1)))).alias("rate"))


def quasi_identifier_coverage(removed: Column, total: Column) -> Column:
    return clamp01(safe_div(removed.cast("double"), total))


def behavioural_loss(similarity: Column) -> Column:
    return clamp01(1 - similarity)


def type_coverage(detected: Column, total: Column) -> Column:
    return clamp01(safe_div(detected.cast("double"), total))


def flipped(labels: DataFrame, values: tuple[str, ...], rate: float = 0.05, id_column: str = "id", seed: int = 42) -> DataFrame:
    """A second annotator's ``b`` beside ``a``: another of the values with that probability, by the record's hash."""
    h = lambda slot: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(slot), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    list_ = F.array(*map(F.lit, values))
    others = F.filter(list_, lambda v: v != F.col("a"))
    moved = F.element_at(others, (h("which") % F.greatest(F.size(others), F.lit(1)) + 1).cast("int"))
    return labels.withColumn("b", F.when((h("flip") / float(1 << 32) < rate) & (F.size(others) > 0), moved).otherwise(F.col("a")))
