"""Personal data: fixed patterns, and identifiers found from the contexts that those appear in.

Base spans (email, ip, card, phone) come from four expressions and their checks. The method
then bootstraps from them:

1. Loose candidates are runs that look like an identifier but meet no base rule. Base spans
   and candidates are instances; the two words before an instance are its pattern.
2. Distinct (pattern, instance) pairs form a graph. A pattern's confidence in a kind is the
   mean score of its instances, damped by a prior; an instance's score is 1 minus the product
   of 1 - confidence over its patterns. Seeds keep score 1 for their kind. ROUNDS rounds make
   a generation.
3. Patterns with MIN_SEEDS distinct supporting instances and MIN_CONFIDENCE are trusted. Their
   instances keep at least the score they have and support other patterns from the next
   generation on, as seeds do. Generations follow each other until one adds no trusted pattern.
4. Trusted patterns mark their candidates, in every text, as spans of their kind. Base spans
   always stay; an added span overlaps none of them.

Everything is built-in functions; texts are read once and never shuffled. Expressions avoid
repeated groups and restarts inside a run, so long texts neither overflow the matcher nor take
quadratic time. A null text is an empty one. Offsets are code points. Rows are told apart by
id and text; repeated rows get the same spans. An empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8
PRIOR = 1.0
CONTEXT_CHARS = 60
# A dot that no domain label follows is set apart with this private character.
_DOT, _OTHER = "\ue000", "\ue001"
_LOCAL = "A-Za-z0-9._%+" + _DOT + "-"

EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE = r"(?<![A-Za-z0-9.@_+])[(]?[0-9][0-9().\x20-]{5,}[0-9](?![A-Za-z0-9@_])"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9-]++"


def _email_text(text: Column) -> Column:
    """The same length; dots that cannot go on a domain are replaced."""
    return F.regexp_replace(F.translate(text, _DOT, _OTHER), F.lit(r"\.(?![A-Za-z0-9-])"), F.lit(_DOT))


def _card_text(text: Column) -> Column:
    """The same length; separators that do not stand between two digits are replaced."""
    return F.regexp_replace(text, F.lit(r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"), F.lit("x"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(value(i) * 2 > 9, value(i) * 2 - 9).otherwise(value(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(i)).otherwise(value(i)))
    return total % 10 == 0


def _matches(rows: DataFrame, kind: str, text: Column, pattern: str, possible: Column) -> DataFrame:
    """rid, kind, nth, gap (characters before, since the last match), match, left (their end)."""
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.transform(F.split(text, pattern), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT_CHARS)).alias("left"))).alias("before"),
    )
    found = rows.filter(possible).select("rid", F.posexplode(pieces).alias("nth", "m")).filter("m.match is not null")
    return found.select("rid", F.lit(kind).alias("kind"), "nth", F.col("m.before.gap").alias("gap"), F.col("m.match").alias("match"), F.col("m.before.left").alias("left"))


def occurrences(docs: DataFrame) -> DataFrame:
    """rid, kind, base, start, end, pattern, instance for base spans and loose candidates of ``docs`` (rid, text)."""
    text = F.col("text")
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    rows = docs.withColumn("digits", digits)
    n = F.col("digits")
    parts = [
        _matches(rows, "email", _email_text(text), EMAIL, F.contains(text, F.lit("@"))),
        _matches(rows, "ip", text, IP, n >= 4),
        _matches(rows, "card", _card_text(text), CARD, n >= 13),
        _matches(rows, "phone", text, PHONE, F.contains(text, F.lit("+")) & (n >= 9)),
        _matches(rows, "loose", text, LOOSE, n >= 7),
        _matches(rows, "loose_email", text, LOOSE_EMAIL, F.contains(text, F.lit("@")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)"))),
    ]
    found = reduce(DataFrame.unionByName, parts).dropDuplicates(["rid", "kind", "nth"])
    upto = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(upto)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - length)
    number = _digits(F.col("match"))
    long_enough = lambda least, most: F.length(number).between(least, most)
    small = F.forall(F.split("match", r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    good = (
        F.when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", F.when(long_enough(13, 19), luhn(number)).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", long_enough(9, 15))
        .when(F.col("kind") == "loose", long_enough(7, 19))
        .otherwise(F.lit(True))
    )
    context = F.lower(F.trim(F.regexp_extract("left", r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$", 0)))
    named = F.when(F.col("kind").contains("email"), F.lower("match")).otherwise(number)
    found = found.filter(good).select("rid", "kind", (~F.col("kind").contains("loose")).alias("base"), "start", "end", context.alias("pattern"), named.alias("instance"))
    found = cut_lineage(found)
    # A candidate that overlaps a base span is that span.
    base = found.filter("base").groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    loose = found.filter("not base").join(base, "rid", "left")
    apart = ~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    return found.filter("base").unionByName(loose.filter(F.coalesce(apart, F.lit(True))).drop("spans"))


def pattern_confidence(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pattern, kind, confidence, seeds of the trusted patterns, by generations of scoring over the pattern-instance graph."""
    edges = found.filter("pattern <> ''").groupBy("pattern", "instance").agg(F.max(F.when(F.col("base"), F.col("kind"))).alias("seed"))
    edges = cut_lineage(edges)
    sizes = cut_lineage(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")))
    open_ = edges.filter("seed is null")
    held = cut_lineage(edges.filter("seed is not null").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score")))
    doubt = F.exp(F.sum(F.log(F.greatest(1.0 - F.col("confidence"), F.lit(1e-9)))))
    best = F.max("score").alias("score")
    known = 0
    while True:
        # Instances that are held when a generation begins are its support.
        scores = held.withColumn("held", F.lit(1))
        for last in (i == rounds - 1 for i in range(rounds)):
            sums = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum("held").alias("seeds"))
            patterns = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("size") + PRIOR)).alias("confidence"), "seeds")
            patterns = cut_lineage(patterns)
            if not last:
                scored = open_.join(patterns, "pattern").groupBy("instance", "kind").agg((1.0 - doubt).alias("score")).withColumn("held", F.lit(0))
                both = held.withColumn("held", F.lit(1)).unionByName(scored)
                scores = cut_lineage(both.groupBy("instance", "kind").agg(best, F.max("held").alias("held")))
        trusted = cut_lineage(patterns.filter((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence)))
        # Scores only rise, so trusted patterns stay trusted.
        before, known = known, trusted.count()
        if known <= before:
            return trusted
        scored = open_.join(trusted, "pattern").groupBy("instance", "kind").agg((1.0 - doubt).alias("score"))
        held = cut_lineage(held.unionByName(scored).groupBy("instance", "kind").agg(best))


def personal_data(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id and spans: array of (kind, base, start, end), by kind as in KINDS and then by start."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut_lineage(occurrences(keyed.select("rid", "text")))
    trusted = pattern_confidence(found, ROUNDS, min_seeds, min_confidence)
    best = trusted.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("known"))
    added = found.filter("not base").join(best, "pattern").select("rid", F.col("known").alias("kind"), "base", "start", "end")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    every = found.filter("base").select("rid", "kind", "base", "start", "end").unionByName(added)
    spans = every.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct(order.alias("place"), "start", "end", "kind", "base"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<place:bigint,start:bigint,end:bigint,kind:string,base:boolean>>)")
    return keyed.select("doc_id", "rid").join(spans, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op7_personal_data(spark, sf_dir):
    done = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
