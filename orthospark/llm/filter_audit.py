"""Filter interaction audit: what each filter removes in every order of application, by a recursive CTE over filter prefixes.

Every document fails some of the filters; which ones is its mask.  Documents are counted into cells, one for each part and
mask, with how many are good and toxic.  A recursive CTE then extends a prefix of filters by each letter that it does not have,
joins the part's cells, carries the bits applied so far and emits the metrics of the new step: 325 prefixes a part, however
many documents there are.  The orders are the prefixes of full length; each step of an order is one of its beginnings.

Text passes through one scan; what is shuffled is a digest, a mask and counts.  Whether a text was seen under a smaller id
(filter E) is decided on rows that are counted by (digest, part, labels) first, so a text that fills a third of the table is a
few rows by then.

Defined cases: a null text is empty, a null part the empty string; a document without words fails A and none of B, C, D;
a null id has no smaller one, so such a row passes E; rows that share the smallest id of a text all pass E; label rows of one id are combined (good or toxic if any
says so); documents without labels are neither; an empty table has no part and an empty result; a very long text is one value
of a row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

LETTERS = "ABCDE"
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the filters that they fail; bit k of a mask is the k-th letter's."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    own = conditions(F.col("body"))
    bits = sum((F.when(own[x], 1 << LETTERS.index(x)).otherwise(0) for x in "BCD"), F.when(own["A"], 1).otherwise(0))
    rows = rows.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), bits.cast("int").alias("bits"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marked, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Rows of a text by part and labels: how many, how many without an id, the smallest id and how many have it.
    by = ["digest", "bits", "part", "good", "toxic"]
    per_id = rows.groupBy(*by, "id").agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    held = per_id.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("without"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    held = written(held, "texts")
    # Most texts have one row; only those of several are joined with their smallest id.
    several = held.groupBy("digest").agg(F.min("first.id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("digest", "least")
    rows = held.join(several, "digest", "left")
    pass_e = F.when(F.col("least").isNull() | (F.col("least") == F.col("first.id")), F.coalesce("first.n", F.lit(0))).otherwise(0) + F.col("without")
    split = F.explode(F.array(F.struct(F.col("bits").alias("mask"), pass_e.alias("n")), F.struct((F.col("bits") + (1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - pass_e).alias("n")))).alias("x")
    rows = rows.select("part", "good", "toxic", split).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    counted = written(rows.groupBy("part", "mask").agg(*[F.sum(n).cast("long").alias(name) for n, name in ((F.col("n"), "n"), (F.when(F.col("good"), F.col("n")).otherwise(0), "n_good"), (F.when(F.col("toxic"), F.col("n")).otherwise(0), "n_toxic"))]), "cells")
    dropped(held)
    return counted


def _sum(what: str, where: str) -> str:
    return f"aggregate(cells, 0L, (s, x) -> s + if({where}, x.{what}, 0L))"


WALK = f"""
WITH RECURSIVE letters (letter, bit) AS (VALUES {", ".join(f"('{x}', {1 << k})" for k, x in enumerate(LETTERS))}),
parts AS (SELECT part, array_agg(struct(mask, n, n_good, n_toxic)) AS cells FROM {{cells}} GROUP BY part),
walk (part, prefix, step, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM parts
  UNION ALL
  SELECT w.part, concat(w.prefix, l.letter), w.step + 1, w.applied | l.bit, l.letter,
    {_sum("n", "(x.mask & (w.applied | l.bit)) = 0")},
    {_sum("n", "(x.mask & w.applied) = 0 AND (x.mask & l.bit) <> 0")},
    {_sum("n", "(x.mask & w.applied) <> 0 AND (x.mask & l.bit) <> 0")},
    {_sum("n", "x.mask = l.bit")},
    {_sum("n_good", "(x.mask & w.applied) = 0 AND (x.mask & l.bit) <> 0")},
    {_sum("n_toxic", "(x.mask & w.applied) = 0 AND (x.mask & l.bit) <> 0")}
  FROM walk w JOIN letters l ON (w.applied & l.bit) = 0 JOIN parts p ON p.part = w.part
)
SELECT * FROM walk WHERE step > 0
"""


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps, removes, finds removed already, and loses."""
    spark = docs.sparkSession
    counted = cells(docs, labels, text, id, part)
    # The recursion's rows are 326 a part; Spark's own limit on them would refuse tables of many parts.
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        walk = written(spark.sql(WALK.format(cells="{cells}"), cells=counted), "walk")
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)
    dropped(counted)
    full = len(LETTERS)
    orders = walk.where(F.col("step") == full).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(full))).alias("step"))
    steps = orders.withColumn("prefix", F.col("filter_order").substr(F.lit(1), F.col("step")))
    # A prefix of k letters begins (5 - k)! orders.
    shapley = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(F.lit(full) - F.col("step"))).cast("long").alias("shapley"))
    rows = walk.drop("step", "applied").join(shapley, ["part", "letter"])
    return steps.join(rows, ["part", "prefix"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH bodies AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
judged AS (
  SELECT doc_id, part, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(body, '[^A-Z]', '', 'g')) AS upper_letters,
    (min(doc_id) OVER (PARTITION BY body)) < doc_id AS e
  FROM bodies
),
marked AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {A: len(words) < 50, B: 100 * len(list_distinct(words)) < 65 * len(words), C: 100 * upper_letters > 5 * length(body), D: regexp_matches(body, '[#$%&*|]'), E: coalesce(e, false)} AS f
  FROM judged LEFT JOIN marked USING (doc_id)
),
masks AS (
  SELECT part, f.A::int + 2 * f.B::int + 4 * f.C::int + 8 * f.D::int + 16 * f.E::int AS mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM failed GROUP BY ALL
),
letters (letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a JOIN letters b ON a.bit <> b.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit) JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
steps AS (
  SELECT filter_order, step::int AS step, bit, (SELECT coalesce(sum(x.bit), 0)::int FROM letters x WHERE contains(substring(filter_order, 1, step - 1), x.letter)) AS applied
  FROM orders, range(1, 6) r(step) JOIN letters ON letter = substring(filter_order, step, 1)
),
measured AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n_good ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n_toxic ELSE 0 END)::bigint AS toxic_lost
  FROM steps, masks GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM measured
"""
