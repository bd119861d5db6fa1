"""Quality rules: a threshold table compiled into one projection.

A rule names a metric and the range it must lie in.  ``metrics()`` holds the
metrics as Column expressions; ``compile_rules()`` turns a table of rules into one
boolean Column.  No user function runs: every expression is a Spark built-in,
and the plan is scan, two projections and nothing else - no shuffle.

Defined results: a null text counts as empty; an empty text has all metrics zero
and fails the word minimum; repeated rows are judged each on its own; a null in any
other column plays no part; columns with the names used here are kept as they are
and shadow nothing, since work columns take names that the table lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import NOT_SPACES, SPACES, fresh

#: Function words of the corpus languages (en, de, fr, es).
STOP_WORDS = tuple(
    "the of and to in a is that for it was on with as be at by this have from or an are not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des et un une du que qui dans en pour au sur pas par ce il est ne se plus "
    "el los las del y o que se un una por con para es no al lo su como más "
    "en".split()
)


@dataclass(frozen=True)
class Rule:
    """The metric must be at least ``low`` and at most ``high`` where those are given."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table.  Ratios are of words, lines or characters as named.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_word_ratio", high=0.5),
    Rule("word_length_low", "mean_word_chars", low=2.0),
    Rule("word_length_high", "mean_word_chars", high=20.0),
    Rule("symbols", "symbol_word_ratio", high=0.3),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def word_array(text: Column) -> Column:
    """Words of the whole text, in order."""
    return F.array_remove(F.split(text, f"{SPACES}+"), "")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window, in order.  ``words`` must be a column of the table."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first included.

    ``hashes`` must be a column of the table.  Texts whose windows all differ, most of
    them, cost one hash set.  Else the windows are sorted with their positions, so equal ones
    stand side by side; a word is counted once however many repeated windows cover it: the
    sum over repeated positions of min(3, distance to the last one).
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.filter(
        F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull(),
    )
    spots = F.sort_array(F.array_distinct(F.flatten(pairs)))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(spots)).otherwise(F.lit(0)).cast("long")


def _covered(spots: Column) -> Column:
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n"))
    return F.aggregate(spots, start, step, lambda a: a["n"])


def compile_rules(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> Column:
    """True where every rule holds; all rules become one expression of the projection."""
    held = F.lit(True)
    for r in rules:
        m = metrics[r.metric]
        if r.low is not None:
            held = held & (m >= F.lit(r.low))
        if r.high is not None:
            held = held & (m <= F.lit(r.high))
    return held


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> tuple[DataFrame, str]:
    """The table with one struct column more, and that column's name.

    The struct holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed and kept (boolean).
    """
    text, words, lines, hashes, counts, out = (fresh(docs, s) for s in ("text", "words", "lines", "hashes", "counts", "quality"))
    t = F.col(text)
    has_word = lambda x: x.rlike(NOT_SPACES)
    step = docs.withColumn(text, F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    step = step.withColumns({words: word_array(t), lines: F.filter(F.split(t, "\n", -1), has_word)})
    step = step.withColumn(hashes, window_hashes(F.col(words)))
    w, n = F.col(words), F.size(F.col(words)).cast("long")
    raw = F.struct(
        n.alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col(hashes)).alias("n_repeat_words"),
        F.size(F.col(lines)).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    step = step.withColumn(counts, raw)
    c = lambda k: F.col(counts)[k]
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    metrics = {
        "n_words": c("n_words"),
        "repeat_word_ratio": per(c("n_repeat_words"), c("n_words")),
        "mean_word_chars": per(c("word_chars"), c("n_words")),
        "symbol_word_ratio": per(c("n_symbols"), c("n_words")),
        "stop_word_ratio": per(c("n_stop_words"), c("n_words")),
        "dup_line_ratio": per(c("n_dup_lines"), c("n_lines")),
    }
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    verdict = F.struct(
        *[c(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & compile_rules(rules, metrics)).alias("kept"),
    )
    return step.withColumn(out, verdict).drop(text, words, lines, hashes, counts), out


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The documents that pass, with the table's own columns.

    explode() stands between verdict and filter: a filter pushed through the projections would
    bring the metrics' expressions back together and split the text once for each window.
    """
    judged, q = judge(docs, rules, text_column)
    one = fresh(judged, "kept")
    judged = judged.select("*", F.explode(F.array(F.col(q)["kept"])).alias(one))
    return judged.filter(F.col(one)).drop(q, one)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    judged, q = judge(docs, rules)
    return judged.select("doc_id", f"{q}.*")


def _rules_sql(rules: tuple[Rule, ...]) -> str:
    tests = [f"{r.metric} {sign} {bound}" for r in rules for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " and ".join(tests)


SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '{NOT_SPACES}+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACES}')) as l from d),
g as (select r, unnest(range(1, len(w) - 1)) as i, w from w),
k as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from g),
c as (select r, count(distinct i + j)::bigint as n_repeat_words from k, (values (0), (1), (2)) v(j) where n > 1 group by r),
b as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines,
         len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) as n_stop_words
  from w left join c using (r)),
m as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, case when n_words > 0 then n_repeat_words / n_words::double else 0 end as repeat_word_ratio,
         case when n_words > 0 then word_chars / n_words::double else 0 end as mean_word_chars, case when n_words > 0 then n_symbols / n_words::double else 0 end as symbol_word_ratio,
         case when n_words > 0 then n_stop_words / n_words::double else 0 end as stop_word_ratio, case when n_lines > 0 then n_dup_lines / n_lines::double else 0 end as dup_line_ratio
  from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_rules_sql(RULES)} as kept from m
"""
