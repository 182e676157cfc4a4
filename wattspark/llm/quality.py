"""Quality rules: a short-circuit cascade over DataFrame expressions.

A rule is a Boolean column that is true where a document is rejected. On a bounded sample from files all over the table the cost
(seconds beyond those of no rule) and the selectivity (share rejected of what earlier rules leave) of each rule are estimated, and
rules are ordered by rejection per cost; the cascade is one CASE expression, so that a later rule runs only on what the earlier ones keep. The order changes what
is computed, never the verdict.

Nulls: a null text is an empty text, which has no words and fails. Other columns are passed on unread, whatever their names. Equal and
repeated rows get equal verdicts. An empty table gives an empty result, in the order in which rules are given.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \x09-\x0D]+"
#: Positions fit in this many bits beside a part of the hash; longer texts are sorted in full.
POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Window hashes are sorted as plain longs that end in their position; neighbours with one front part are
    candidates, and only these are compared by their whole hashes.
    """
    low = (1 << POSITION_BITS) - 1
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]))))

    def doubles(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        n = F.size(s)
        return F.filter(s, lambda x, i: F.when(i > 0, same(x, s[i - 1])).otherwise(False) | F.when(i < n - 1, same(x, s[i + 1])).otherwise(False))

    def positions(g: Column) -> Column:
        packed = F.sort_array(F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))
        near = let(packed, lambda s: F.transform(doubles(s, lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
        full = F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: i)
        some = let(F.when(F.size(g) < low, near).otherwise(full), lambda c: F.sort_array(F.transform(c, lambda i: F.struct(g[i].alias("g"), i.alias("i")))))
        return let(some, lambda s: F.sort_array(F.transform(doubles(s, lambda a, b: a["g"] == b["g"]), lambda x: x["i"])))

    # Windows at p and q > p overlap in 3 - (q - p) words, so each adds the distance to the next, 3 at most.
    covered = let(hashes, lambda g: F.when(F.size(g) < 2, F.lit(0)).otherwise(let(positions(g), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))))
    return covered.cast("bigint")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    stats = let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("_base", stats)
    out = out.withColumns({"n_words": F.col("_base.n_words"), "word_chars": F.col("_base.word_chars"), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"), "n_dup_lines": lines.cast("bigint"), "n_repeat_words": F.col("_base.n_repeat_words")}).drop("_base")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """fails: rejects where true; null counts as false."""

    name: str
    fails: Column


def text_rules(text: str = "text") -> list[Rule]:
    """Rules on the text alone; each bears out only plain junk."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    return [
        Rule("symbols", 10 * F.regexp_count(t, F.lit(r"[#*$%&|<>]")) > n),
        Rule("few_letters", 2 * F.regexp_count(t, F.lit(r"\p{L}")) < n),
        Rule("long_words", t.rlike(r"[^ \x09-\x0D]{1000}")),
        Rule("repeated_lines", let(lines, lambda x: (F.size(x) >= 4) & (2 * F.size(F.array_distinct(x)) < F.size(x)))),
        Rule("control_characters", 20 * F.regexp_count(t, F.lit(r"[\x00-\x08\x0E-\x1F�]")) > n),
    ]


def column_rules() -> list[Rule]:
    """Rules on what with_base() adds."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbol_words", 10 * F.col("n_symbols") > 3 * n),
        Rule("word_length", (chars < 2 * n) | (chars > 20 * n)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > n),
    ]


#: Of a sampled text, the characters that estimates see; verdicts see all.
SAMPLE_CHARS = 1 << 15


def sampled(docs: DataFrame, text: str, rows: int, files: int = 16) -> list:
    """At most `rows` texts, their first SAMPLE_CHARS characters, from up to `files` of docs' files that lie evenly among them; of docs without such files, from a sample."""
    short = F.substring(F.col(text), 1, SAMPLE_CHARS).alias(text)
    names = sorted(docs.inputFiles())
    if names:
        some = [names[i * len(names) // min(files, len(names))] for i in range(min(files, len(names)))]
        each = docs.sparkSession.read.parquet(*some)
        if dict(each.dtypes).get(text) == "string":
            parts = [docs.sparkSession.read.parquet(f).select(short).limit(-(-rows // len(some))) for f in some]
            return reduce(DataFrame.unionAll, parts).collect()[:rows]
    return docs.select(short).sample(0.2, 17).limit(rows).collect()


def ordered(rules: list[Rule], docs: DataFrame, sample_rows: int = 256, repeats: int = 8, tries: int = 3) -> list[Rule]:
    """Rules by rejection per cost, on at most sample_rows rows of docs.

    A rule's cost is the least time of some tries over the sample repeated, less that of a rule that does nothing, and never under a
    tenth of the latter: planning is in both. Its rejection is the share of the rows that the rules chosen before it leave.
    """
    spark = docs.sparkSession
    rows = docs.limit(sample_rows).collect()
    if not rows:
        return rules
    small = spark.createDataFrame(rows, docs.schema)
    fails = lambda rule: F.coalesce(rule.fails, F.lit(False))
    verdicts = small.select(*(fails(r).alias(f"r{i}") for i, r in enumerate(rules))).collect()
    many = small.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).coalesce(1)

    def seconds(condition: Column) -> float:
        took = []
        for _ in range(tries):
            began = time.perf_counter()
            many.agg(F.sum(condition.cast("int"))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(F.col("_again") < 0)
    cost = [max(seconds(fails(r)) - idle, 0.1 * idle) for r in rules]
    left, rest, out = list(verdicts), list(range(len(rules))), []
    while rest:
        rate = {i: (sum(v[i] for v in left) + 1 / (len(rows) + 2)) / cost[i] for i in rest}
        best = max(rest, key=lambda i: (rate[i], -i))
        out.append(rules[best])
        rest.remove(best)
        left = [v for v in left if not v[best]]
    return out


def cascade(docs: DataFrame, rules: list[Rule], sample: DataFrame | None = None, name: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule, in the estimated order, that rejects a document; null: none does. sample: rows to estimate on, docs' own without it."""
    chosen = ordered(rules, docs if sample is None else sample)
    out = F.lit(None).cast("string")
    for rule in reversed(chosen):
        out = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return docs.withColumn(name, out)


def quality_verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base columns, rejected_by and kept."""
    base = with_base(docs, text)
    spark = docs.sparkSession
    some = spark.createDataFrame(sampled(docs, text, 256), docs.select(text).schema)
    found = cascade(base, text_rules(text) + column_rules(), sample=with_base(some, text))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op8_quality_cascade(spark, sf_dir):
    """Base counts of every document of `documents`, and the cascade's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_verdicts(docs).drop("text", "rejected_by")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, t, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
 len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > length(t) OR 2 * len(regexp_extract_all(t, '\p{L}')) < length(t) OR regexp_matches(t, '[^ \x09-\x0D]{1000}')
 OR (len(ls) >= 4 AND 2 * len(list_distinct(ls)) < len(ls)) OR 20 * len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x{FFFD}]')) > length(t)
 OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_words) AS kept
FROM f
"""
