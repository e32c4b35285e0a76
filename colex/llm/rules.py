"""Quality rules as a bitmask ledger (DataFrame functions only).

`ledger` evaluates every rule once per document and stores its measurements and one
failure bit per rule.  Policies are versioned masks over those bits: applying another
policy, comparing two, or asking what one rule alone removes (an ablation) reads the
ledger, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Rules in bit order: name, and the failing condition over the measurements.
RULES: dict[str, str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_upper > n_letters",
    "exclaims": "5 * n_exclaims > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 14 * n_words",
    "no_letters": "2 * n_letters < word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


BASE_POLICY = Policy("base", ("few_words", "repeats"))
POLICIES = (
    BASE_POLICY,
    Policy("v1", ("few_words", "repeats", "symbols", "shouting")),
    Policy("strict", tuple(RULES)),
    Policy("v2", tuple(r for r in RULES if r != "duplicate_lines")),  # menus repeat lines in clean documents too
)
CURRENT = POLICIES[-1]


def _chars(text: Column, chars: str) -> Column:
    """How many characters of the text are in `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window that occurs at least twice in the text.

    Windows are sorted as (hash, start); those beside an equal one repeat.  Their starts,
    sorted, cover min(3, distance to the next start) words each, so the cost is that of
    two sorts, also for long and very repetitive texts.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(p, a)["k"] == F.get(p, b)["k"], F.lit(False))
            hits = F.filter(p, lambda _, j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(hits, lambda h: h["i"]))

        def total(s: Column) -> Column:
            gaps = F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(placed, lambda p: let(repeated(p), total))

    several = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(several)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document.

    A null or empty text has no words and measures 0 throughout.  Words are maximal runs without
    space and U+0009..U+000D; lengths are in code points.  Repeated rows are measured each, and an
    empty table gives an empty result.  A very long text costs two sorts of its own windows, in
    memory in proportion to its length.  Only doc_id and text are read, other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    bare = let(
        F.translate(text, SPACE_CHARS, ""),
        lambda t: F.struct(
            F.length(t).cast("long").alias("chars"),
            _chars(t, SYMBOLS).cast("long").alias("symbols"),
            _chars(t, "!").cast("long").alias("exclaims"),
            F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("letters"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("upper"),
        ),
    )
    return docs.select("doc_id", by_words.alias("w"), by_lines.alias("l"), bare.alias("b")).select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        F.col("b.chars").alias("word_chars"),
        F.col("b.symbols").alias("n_symbols"),
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
        F.col("b.exclaims").alias("n_exclaims"),
        F.col("b.letters").alias("n_letters"),
        F.col("b.upper").alias("n_upper"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failed`, a long with one bit per rule of RULES."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def rejects(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policies(book: DataFrame, policies=POLICIES) -> DataFrame:
    """doc_id and one boolean kept_<version> per policy."""
    return book.select("doc_id", *[(~rejects(p)).alias(f"kept_{p.version}") for p in policies])


def ablations(book: DataFrame, policies=POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and documents that only it rejects.

    The ledger is first counted by its distinct bit patterns (at most 2^rules rows), so
    every ablation of every policy is arithmetic on a table of fixed size.
    """
    patterns = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *[
            F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.lit(p.mask).cast("long").alias("mask"))
            for p in policies
            for r in p.rules
        ]
    )
    hit = F.col("failed").bitwiseAND(F.col("c.bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("c.mask")) == F.col("c.bit")
    return (
        patterns.select("failed", "n", F.explode(rules).alias("c"))
        .groupBy("c.policy", "c.rule")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only"),
            F.bit_or("failed").alias("seen_bits"),
        )
    )


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole documents table; `failed` is the ledger."""
    return ledger(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rejects(BASE_POLICY).alias("base_failed"),
        (~rejects(BASE_POLICY) & ~rejects(CURRENT)).alias("kept"),
        "failed",
    )


def rules_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone and with others, over the whole documents table."""
    return ablations(ledger(table(spark, sf_dir, "documents"))).select("policy", "rule", "fails", "only", "seen_bits")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
r AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM d),
h AS (SELECT row_number() OVER () AS id, * FROM r),
e AS (SELECT id, unnest(g) AS k, unnest(range(1, len(g) + 1)) AS i FROM h),
f AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS c FROM e) WHERE c > 1),
n AS (SELECT id, count(DISTINCT p) AS repeat FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeat, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM h LEFT JOIN n USING (id)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_upper > n_letters THEN 8 ELSE 0 END)
    + (CASE WHEN 5 * n_exclaims > n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 14 * n_words THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 223) = 0 AS kept, failed FROM b
"""

_POLICY_ROWS = ", ".join(f"('{p.version}', '{r}', {BIT[r]}, {p.mask})" for p in POLICIES for r in p.rules)
ABLATIONS_SQL = f"""
WITH book AS ({OP2_SQL}), c(policy, rule, bit, mask) AS (VALUES {_POLICY_ROWS})
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS fails, count(*) FILTER (failed & mask = bit) AS only, bit_or(failed) AS seen_bits
FROM book, c GROUP BY ALL
"""
