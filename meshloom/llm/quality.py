"""Quality rules with risk-controlled thresholds, in built-in functions only.

A document has four measures of junk, all from 0 up: symbols per word character, the share of
its lines that repeat an earlier one, the share of its words in repeated 8-word windows, and
the share of its words that are repeats. For each stratum (lang; null is one of its own) and
measure a cutoff is chosen on labelled documents:

* A cutoff may be used only if an exact binomial test rejects, at the corrected level, that it
  rejects good documents at a rate above the limit: P(Bin(n, limit) <= k) <= level, with n good
  documents and k of them rejected. That is the exact upper confidence bound, read backwards.
* The cutoffs of a measure are tested from the laxest on and testing stops at the first failure
  (fixed sequence); the level is divided by the number of strata and measures (Bonferroni), and
  the limit by the number of measures. So with probability 1 - LEVEL no stratum loses more than
  LIMIT of its good documents.
* Among the usable cutoffs the one that separates best counts: bad documents rejected less
  GOOD_WEIGHT times good ones, ties to the laxest; none if nothing bad is rejected.

A stratum with too few labels to prove anything rejects nothing but by the fixed base rules.
A null text has no words. Labels without an id or quality do not count; several labels of one
id count as bad if one is. Repeated rows are judged alike. An empty table gives an empty
result. Columns named like an added one are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, let, table, words

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LIMIT = 0.04
LEVEL = 0.05
GOOD_WEIGHT = 10
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)
MEASURES = ("symbol_share", "dup_line_share", "window_share", "repeat_word_share")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_positions(starts: Column, n: int) -> Column:
    """Words covered by windows of n words that begin at the sorted ``starts``."""
    gaps = F.zip_with(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(n)))
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.lit(n) + F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g))


def repeated_words(w: Column, n: int = WINDOW_WORDS) -> Column:
    """Words of ``w`` in n-word windows found twice or more.

    Windows are compared by hash first; only where two hashes agree are they compared as text.
    """
    places = F.sequence(F.lit(1), F.size(w) - (n - 1))
    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(places, lambda i: F.xxhash64(F.slice(h, i, F.lit(n)))))

    def exact(_):
        texts = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i, F.lit(n)), " ").alias("t"), i.alias("i"))))

        def starts(s):
            same = lambda j, e: F.coalesce(F.get(s, j)["t"] == e["t"], F.lit(False))
            hits = F.transform(s, lambda e, j: F.when(same(j - 1, e) | same(j + 1, e), e["i"]))
            return F.array_sort(F.filter(hits, lambda i: i.isNotNull()))

        return let(let(texts, starts), lambda s: _repeat_positions(s, n))

    found = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) > n, found).otherwise(F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` plus the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    filled = lambda x: F.length(_without(x, SPACES)) > 0
    of_words = let(
        words(F.col("text")),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeated_words(w).alias("repeated")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), let(F.filter(x, filled), lambda y: F.size(y) - F.size(F.array_distinct(y))).alias("dup")))
    found = docs.drop(*FEATURES).withColumns({"_words": of_words, "_lines": of_lines})
    return found.withColumns(
        {
            "n_words": F.col("_words.n").cast("long"),
            "word_chars": F.length(_without(text, SPACES)).cast("long"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
            "n_dup_lines": F.col("_lines.dup").cast("long"),
            "n_repeat_words": F.col("_words.repeated").cast("long"),
            "n_distinct_words": F.col("_words.distinct").cast("long"),
        }
    ).drop("_words", "_lines")


def measures() -> dict[str, Column]:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "window_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "repeat_word_share": share(F.col("n_words") - F.col("n_distinct_words"), F.col("n_words")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed term by term in logarithms."""
    import math

    step = math.log(rate) - math.log1p(-rate)
    begin = F.struct((n * F.lit(math.log1p(-rate))).alias("term"), F.lit(0.0).alias("sum"))

    def add(acc, i):
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] + F.log((n - i + 1) / i) + F.lit(step))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), begin, add, lambda acc: acc["sum"])


def chosen_cutoffs(features: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """_stratum and one cutoff per measure (null: none) from labelled documents."""
    bad = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    labelled = features.select("doc_id", _stratum().alias("_stratum"), base_failed().alias("_base"), *[c.alias(m) for m, c in measures().items()])
    labelled = labelled.join(bad, "doc_id")
    # Counts per stratum, measure and the number of cutoffs passed, before any document is repeated.
    passed = lambda m: reduce(lambda a, b: a + b, [(F.col(m) > c).cast("int") for c in CUTOFFS])
    cells = labelled.groupBy("_stratum", "_good", "_base", *[passed(m).alias(m) for m in MEASURES]).agg(F.count(F.lit(1)).alias("_rows"))
    rows = cells.select(
        "_stratum", "_good", "_base", "_rows", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(m).alias("level")) for i, m in enumerate(MEASURES)])).alias("x")
    )
    # Base failures are rejected anyway: they count as neither gain nor harm of a cutoff.
    good, open_ = F.col("_good") > 0, ~F.col("_base")
    # The cutoffs fall, so whoever passes one passes all after it.
    at = lambda j: F.col("x.level") >= len(CUTOFFS) - j
    tests = rows.groupBy("_stratum", F.col("x.m").alias("m")).agg(
        F.sum(F.when(good & open_, F.col("_rows")).otherwise(F.lit(0))).alias("n"),
        F.array(*[F.sum(F.when(good & open_ & at(j), F.col("_rows")).otherwise(F.lit(0))) for j in range(len(CUTOFFS))]).alias("k"),
        F.array(*[F.sum(F.when(~good & open_ & at(j), F.col("_rows")).otherwise(F.lit(0))) for j in range(len(CUTOFFS))]).alias("gain"),
    )
    tests = cut_lineage(tests)
    strata = tests.select("_stratum").distinct().count()
    each = level / max(1, strata * len(MEASURES))
    rate = limit / len(MEASURES)
    tests = tests.select("_stratum", "m", "n", F.posexplode(F.arrays_zip("k", "gain")).alias("j", "t")).select("_stratum", "m", "n", "j", F.col("t.k").alias("k"), F.col("t.gain").alias("gain"))
    # Far more rejections than the limit allows need no sum: their tail is above one half.
    proven = F.when(F.col("k") > F.col("n") * rate, F.lit(False)).otherwise(binomial_tail(F.col("k"), F.col("n"), rate) <= each)
    sequence = Window.partitionBy("_stratum", "m").orderBy("j")
    usable = tests.withColumn("ok", F.min(proven).over(sequence)).filter("ok")
    worth = F.col("gain") - GOOD_WEIGHT * F.col("k")
    best = usable.filter(worth > 0).groupBy("_stratum", "m").agg(F.min_by("j", F.struct((-worth).alias("w"), F.col("j"))).alias("j"))
    cutoff = F.element_at(F.array(*[F.lit(c) for c in CUTOFFS]), F.col("j") + 1)
    wide = [F.max(F.when(F.col("m") == i, cutoff)).alias(f"_cut_{m}") for i, m in enumerate(MEASURES)]
    return cut_lineage(best.groupBy("_stratum").agg(*wide))


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n"))


def judged(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` plus base_failed and kept. The cutoffs are small; the join picks its way by their size."""
    rejects = reduce(lambda a, b: a | b, [F.coalesce(c > F.col(f"_cut_{m}"), F.lit(False)) for m, c in measures().items()])
    found = features.drop("base_failed", "kept").withColumn("_stratum", _stratum()).join(cutoffs, "_stratum", "left")
    found = found.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | rejects)})
    return found.drop("_stratum", *[f"_cut_{m}" for m in MEASURES])


def quality_rules(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) plus the counts, base_failed and kept."""
    features = cut_lineage(measured(docs))
    return judged(features, chosen_cutoffs(features.select("doc_id", "lang", *FEATURES), labels, limit, level))


def op5_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    features = cut_lineage(measured(docs).drop("text"))
    found = judged(features, chosen_cutoffs(features, labels))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PASSED = " + ".join(f"(v > {c})::INT" for c in CUTOFFS)
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), p AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
  GROUP BY 1
), l AS (
  SELECT doc_id, len(x) AS n_lines, len(y) - len(list_distinct(y)) AS n_dup_lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x, list_filter(string_split(text, chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) AS y FROM w)
), f AS (
  SELECT doc_id, 'l' || lang AS lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_distinct(w))::BIGINT AS n_distinct
  FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)
), v AS (
  SELECT *, coalesce(lang, 'n') AS stratum, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         [CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
          CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END, CASE WHEN n_words > 0 THEN (n_words - n_distinct) / n_words ELSE 0 END] AS vs
  FROM f
), b AS (
  SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), x AS (
  SELECT stratum, good, unnest([1, 2, 3, 4]) AS m, unnest(vs) AS v FROM v JOIN b USING (doc_id) WHERE NOT base_failed
), s AS (
  SELECT count(DISTINCT stratum) AS strata FROM v JOIN b USING (doc_id)
), y AS (
  SELECT stratum, m, good, {_PASSED} AS passed FROM x
), t AS (
  SELECT stratum, m, j, count(*) FILTER (good > 0) AS n, count(*) FILTER (good > 0 AND passed >= {len(CUTOFFS)} - j) AS k,
         count(*) FILTER (good <= 0 AND passed >= {len(CUTOFFS)} - j) AS gain
  FROM y, range({len(CUTOFFS)}) r(j) GROUP BY 1, 2, 3
), q AS (
  SELECT t.*, k <= n * {LIMIT} / 4 AND list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({LIMIT} / 4) + (n - i) * ln(1 - {LIMIT} / 4)))) <= {LEVEL} / (4 * strata) AS ok
  FROM t, s
), u AS (
  SELECT *, gain - {GOOD_WEIGHT} * k AS worth FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, m ORDER BY j) AS usable FROM q) WHERE usable
), c AS (
  SELECT stratum, m, arg_min(j, -worth * 100 + j) AS j FROM u WHERE worth > 0 GROUP BY 1, 2
), r AS (
  SELECT DISTINCT v.doc_id FROM v JOIN c USING (stratum) WHERE v.vs[c.m] > {list(CUTOFFS)}[c.j + 1]
)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR r.doc_id IS NOT NULL) AS kept
FROM v LEFT JOIN r ON r.doc_id = v.doc_id
"""
