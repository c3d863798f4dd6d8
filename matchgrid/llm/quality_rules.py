r"""Quality rules with risk-controlled thresholds.

Counts of every text come from array functions. Documents fail the fixed base
rules or a learned one. The learned rule rejects a document if one of its measures (share
of symbols, of repeated lines, of repeated words) exceeds that measure's cutoff. It is
chosen per stratum (the document's lang) on the labelled documents: rules are tried in a
fixed order, each tighter than the one before (first the cutoff of symbols goes down, then that
of lines, then that of words), and a rule is allowed if the exact binomial test rejects
that it loses more than ``RISK`` of the good documents. A sequence that ends at its first failure needs no
correction. Over strata Holm's procedure holds for the rules up to the last one of lines (``FIRM``): a stratum for which
all of them are allowed leaves its part of the level to the others. The rules of words, which good documents break
more often, come after them with a part of the level (``APART``) that the strata share evenly. So with probability
1 - ERROR every stratum keeps all but RISK of its good documents.

Strata with fewer good documents than the test needs at the full level (``enough``) are pooled into one, and the
bound is for the pool as a whole. A stratum without good documents has no learned rule.

A window of five words found twice or more in a text makes its words repeated.
Windows are compared by hash and only texts that repeat one are sorted.

Null text has no words and fails. Very long texts are counted whole. Null and empty
lang are one stratum. Labels are matched by doc_id; in the tests a doc_id counts once
in a stratum, with its largest measures, however often either table repeats it, as the
bound is for independent documents. A measure equal to a cutoff does not exceed it; of equally
allowed cutoffs the tightest is used. Every row gets its verdict. Empty tables give an
empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.sources.store import stored

SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
RISK, ERROR = 0.03, 0.05
MEASURES = ["symbols", "dup_lines", "repeats"]
CUTOFFS = [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5]
#: Rules of the sequence: every cutoff of the first measure, the largest first, then those of the others.
RULES = len(MEASURES) * len(CUTOFFS)
FIRM, APART = 2 * len(CUTOFFS), 0.2


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` (with its other columns) and the counts of its text, without the text."""
    keep = [c for c in docs.columns if c.lower() != "text"]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    one = docs.select(
        *keep,
        F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    two = one.select(
        *keep, "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.aggregate(F.transform("_words", F.length), F.lit(0).cast("long"), lambda a, x: a + x).alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    n = F.size("_hashes")
    windows = F.when(n > 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(5)))))
    three = two.withColumn("_windows", windows).drop("_hashes")
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    four = three.withColumn("_sorted", F.when(again, F.array_sort(placed))).drop("_windows")
    of = lambda j: F.get("_sorted", j)["x"]
    twice = F.filter("_sorted", lambda e, j: e["x"].eqNullSafe(of(j - 1)) | e["x"].eqNullSafe(of(j + 1)))
    five = four.withColumn("_at", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("_sorted")
    # A repeated window adds the words up to the next one, five at most.
    added = F.transform("_at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_at", j + 1) - p, F.lit(5))))
    total = F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)
    return five.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_at")


def measured(counted: DataFrame) -> DataFrame:
    """The base rule and the measures of the learned ones."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return (
        counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("symbols", F.col("n_symbols") / chars)
        .withColumn("dup_lines", F.col("n_dup_lines") / words)
        .withColumn("repeats", F.col("n_repeat_words") / words)
        .withColumn("stratum", F.coalesce("lang", F.lit("")))
    )


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), summed from term k down.

    Terms more than 12 standard deviations further down are less than e-70 of the
    first one and left out, so large strata need some square root of n steps.
    """
    k, n = k.cast("long"), n.cast("long")
    start = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p))
    first = F.struct(start.alias("term"), start.alias("sum"))
    low = F.greatest(F.lit(1), k - F.ceil(12 * F.sqrt(n * p * (1 - p))) - 50)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.when(k < 1, F.exp(n * math.log(1 - p))).otherwise(F.aggregate(F.sequence(F.greatest(k, F.lit(1)), low, F.lit(-1)), first, step)["sum"])


def log_factorial(n: Column) -> Column:
    """Exact up to 20, then Stirling's series (error below 1e-12)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def enough(risk: float = RISK, error: float = ERROR) -> int:
    """Good documents of which none may be lost for the test to pass at the whole level of the firm rules."""
    return math.ceil(math.log(error * (1 - APART)) / math.log(1 - risk))


def first_loss(value: Column, place: int) -> Column:
    """The first rule that loses a document by its measure number ``place``, null if none does."""
    falling = CUTOFFS[::-1]
    return F.coalesce(*(F.when(value > cutoff, place * len(CUTOFFS) + i + 1) for i, cutoff in enumerate(falling)))


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one column per measure): the cutoffs of the tightest rule that the labels allow, null for none."""
    good = measures.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id").filter(~F.col("base_failed"))
    good = good.groupBy("stratum", "doc_id").agg(*(F.max(m).alias(m) for m in MEASURES))
    lost = good.select("stratum", F.least(*(first_loss(F.col(m), i) for i, m in enumerate(MEASURES)), F.lit(RULES + 1)).alias("lost"))
    counts = [F.count_if(F.col("lost") <= rule).alias(f"k{rule}") for rule in range(1, RULES + 1)]
    seen = stored(lost.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "quality-tests")  # one row a stratum
    small = F.col("n") < enough(risk, error)
    unit = F.when(~small, F.col("stratum"))  # null: the pool
    pooled = seen.groupBy(unit.alias("unit")).agg(F.sum("n").alias("n"), *(F.sum(f"k{rule}").alias(f"k{rule}") for rule in range(1, RULES + 1)))
    tests = pooled.select("unit", "n", F.posexplode(F.array(*(f"k{rule}" for rule in range(1, RULES + 1)))).alias("at", "k"))
    p = F.when(F.col("k") < risk * F.col("n"), at_most(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    tests = tests.select("unit", (F.col("at") + 1).alias("rule"), p.alias("p"))
    # Holm over the last firm rules: in the order of their p, each stratum has the level of those that are left. A row a stratum.
    firm = error * (1 - APART)
    last = tests.filter(F.col("rule") == FIRM)
    order = Window.orderBy("p", "unit")
    done = F.col("p") <= firm / (F.col("m") - F.row_number().over(order) + 1)
    ranked = last.withColumn("m", F.count("*").over(Window.partitionBy())).withColumn("done", done)
    ranked = ranked.withColumn("done", F.min("done").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.greatest(F.lit(1), F.col("m") - F.count_if("done").over(Window.partitionBy()))
    whole = F.col("done") | (F.col("p") <= firm / left)
    levels = ranked.select(F.col("unit").alias("_unit"), F.when(F.col("done"), F.col("p")).otherwise(firm / left).alias("level"), F.when(whole, error * APART / F.col("m")).alias("rest"))
    level = F.when(F.col("rule") <= FIRM, F.col("level")).otherwise(F.col("rest"))
    allowed = tests.join(levels, F.col("unit").eqNullSafe(F.col("_unit"))).filter(F.col("p") <= level)
    chosen = allowed.groupBy("unit").agg(F.max("rule").alias("rule"))
    steps = F.array(*map(F.lit, CUTOFFS))
    cutoff = [F.get(steps, len(CUTOFFS) - F.least(F.col("rule") - i * len(CUTOFFS), F.lit(len(CUTOFFS)))) for i in range(len(MEASURES))]
    limits = [F.when(F.col("rule") > i * len(CUTOFFS), c).alias(f"max_{m}") for i, (m, c) in enumerate(zip(MEASURES, cutoff, strict=True))]
    member = seen.select("stratum", unit.alias("_unit"))
    return chosen.join(member, F.col("unit").eqNullSafe(F.col("_unit"))).select("stratum", *limits)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of ``docs`` (doc_id, text, lang) with base_failed and kept."""
    found = measured(stored(counts(docs.select("doc_id", "text", "lang")), "quality-counts"))
    chosen = cutoffs(found, labels)
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return found.join(chosen, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: quality counts and verdict of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_FIRM_LEVEL = ERROR * (1 - APART)
_GRID = ", ".join(f"({c}::DOUBLE)" for c in CUTOFFS)
ORACLE = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
c AS (
  SELECT s.r, doc_id, stratum, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered USING (r)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols::DOUBLE / greatest(word_chars, 1) AS symbols, n_dup_lines::DOUBLE / greatest(n_words, 1) AS dup_lines,
         n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeats FROM c),
good AS (SELECT stratum, doc_id, max(symbols) AS symbols, max(dup_lines) AS dup_lines, max(repeats) AS repeats
         FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
size AS (SELECT stratum, CASE WHEN count(*) >= {enough()} THEN stratum END AS unit FROM good GROUP BY stratum),
rule AS (
  SELECT 9 * m + i AS rule, CASE WHEN m = 0 THEN c ELSE 0.01 END AS a, CASE m WHEN 0 THEN NULL WHEN 1 THEN c ELSE 0.01 END AS b, CASE WHEN m = 2 THEN c END AS c
  FROM (SELECT c, row_number() OVER (ORDER BY c DESC) AS i FROM (VALUES {_GRID}) g(c)), range(3) t(m)),
seen AS (
  SELECT unit, rule, count(*) AS n, count(*) FILTER (symbols > a OR coalesce(dup_lines > b, false) OR coalesce(repeats > c, false)) AS k
  FROM good JOIN size USING (stratum), rule GROUP BY ALL),
p AS (
  SELECT unit, rule, CASE WHEN k < {RISK} * n THEN
    list_sum(list_transform(range(0, k + 1), lambda i: exp(CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END
      + i * ln({RISK}::DOUBLE) + (n - i) * ln(1 - {RISK}::DOUBLE)))) ELSE 1 END AS p FROM seen),
last AS (SELECT *, row_number() OVER (ORDER BY p, unit NULLS FIRST) AS r, count(*) OVER () AS m FROM p WHERE rule = {FIRM}),
done AS (SELECT *, bool_and(p <= {_FIRM_LEVEL}::DOUBLE / (m - r + 1)) OVER (ORDER BY r) AS done FROM last),
level AS (SELECT unit, p AS p_firm, done, m, {_FIRM_LEVEL}::DOUBLE / greatest(1, m - (SELECT count(*) FROM done WHERE done)) AS lv FROM done),
best AS (SELECT p.unit, max(p.rule) AS rule FROM p JOIN level l ON p.unit IS NOT DISTINCT FROM l.unit
         WHERE CASE WHEN rule <= {FIRM} THEN done OR p <= lv ELSE (done OR p_firm <= lv) AND p <= {ERROR * APART}::DOUBLE / m END GROUP BY p.unit),
cuts AS (SELECT stratum, a, b, c FROM size s JOIN best ON s.unit IS NOT DISTINCT FROM best.unit JOIN rule USING (rule))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(symbols > a, false) AND NOT coalesce(dup_lines > b, false) AND NOT coalesce(repeats > c, false) AS kept
FROM m LEFT JOIN cuts USING (stratum)
"""
