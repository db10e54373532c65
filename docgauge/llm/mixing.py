"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target number of words; a source takes complete epochs of
all its documents first, and the fraction that is left by Efraimidis-Spirakis
sampling: a document's key is ``-ln(u) / w`` with `u` from a hash of its id and
`w` its quality, keys are sorted within the source, sizes are summed in that
order, and the sum is cut at what is left of the target.

The prefix sum never sorts a whole source in one task.  Keys are cut into
`BUCKETS` ranges; sums per (source, range) are combined before the shuffle.
Prefix sums over blocks of `BLOCK` ranges tell in which block the cut falls, those
over its ranges (each at most 256 rows a source) in which range, and only the rows
of that one range are sorted.

Rules for odd rows: a null or empty text has size 0, quality `FLOOR` and is
taken 0 times; a null source is a source of its own, last in order; a null
doc_id hashes as the empty string; rows with equal keys go by doc_id (nulls
first), then by size, and repeated rows each count; an empty table gives no
rows; further columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import free_names, small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BUCKETS, BLOCK = 65_536, 256
FLOOR = 0.05
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def letter_share(text: Column) -> Column:
    """Quality of a document: letters among its characters, `FLOOR` at least."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(FLOOR), F.coalesce(F.try_divide(letters.cast("double"), F.length(text).cast("double")), F.lit(0.0)))


def _uniform(doc_id: Column, seed: str) -> Column:
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size) -> the same with `target`: min(cap * size, level * weight), the level such that all targets are share * all sizes.

    That is where resharing the excess by weight ends: sources are capped in the
    order of most / weight, and the first level that caps none of the rest is the
    largest that does.  Sources are few, so one
    ordered window over them is enough; it runs over one row a source.
    """
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    by = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    tried = ranked.withColumn("level", level)
    fits = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tried.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(fits, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, carry: list[str] | None = None, quality=letter_share, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """`carry` columns of `docs` (all by default) with size, source_size, target and taken, under other names where those are in use.

    The four are the last columns, in that order.
    """
    carry = docs.columns if carry is None else carry
    kept = docs.select(*carry)
    size, source_size, target, taken, key, bucket, src, tie = free_names(kept, "size", "source_size", "target", "taken", "mix_key", "mix_bucket", "mix_source", "mix_tie")
    u, w = _uniform(F.col("doc_id"), seed), quality(F.col("text"))
    sized = docs.select(*[F.col(c) for c in carry], n_words(F.col("text")).alias(size), (-F.ln(u) / w).alias(key), F.col("source").alias(src), F.col("doc_id").alias(tie))
    sized = sized.withColumn(bucket, F.least(F.floor((1 - F.exp(-F.col(key))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sized = written(sized, "mix-sized")

    sums = sized.groupBy(F.col(src).alias("source"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words"))
    sums = written(sums, "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("words_due", F.floor("target")).withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("words_due"), F.col("source_size"))), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("words_due") - F.col("epochs") * F.col("source_size"))
    plan = small(plan, "mix-plan")

    def with_cut(parts: DataFrame, by: str, start) -> DataFrame:
        """Of a source's parts the one that its cut falls in, with the words before it."""
        before = start + F.sum("words").over(Window.partitionBy("source").orderBy(by)) - F.col("words")
        return parts.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))

    due = plan.select(F.col("source").alias("s"), "rest")
    blocks = sums.groupBy("source", F.floor(F.col("bucket") / BLOCK).alias("block")).agg(F.sum("words").alias("words"))
    blocks = with_cut(blocks.join(due, F.col("source").eqNullSafe(F.col("s"))), "block", F.lit(0)).select("s", "block", "rest", F.col("before").alias("start"))
    blocks = small(blocks, "mix-blocks")
    cut = with_cut(sums.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("bucket") / BLOCK) == F.col("block"))), "bucket", F.col("start"))
    # at most one range of a source holds the cut; with none, the source ends on a range's edge
    cut = cut.select(F.col("source").alias("c_source"), F.col("bucket").alias("cut"), "before")
    plan = small(plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-cut")

    # every name of the plan is one that no column of the rows has
    of = dict(zip([*plan.columns, "more"], free_names(sized, *(f"mix_plan_{c}" for c in plan.columns), "mix_more")))
    rows = sized.join(plan.withColumnsRenamed({c: of[c] for c in plan.columns}), F.col(src).eqNullSafe(F.col(of["source"])))
    cols = [*carry, F.col(size), F.col(of["source_size"]).alias(source_size), F.col(of["target"]).alias(target)]
    base = F.col(of["epochs"]) * F.col(size)
    inside = F.col(bucket) == F.col(of["cut"])
    # below the cut a document is taken once more, above it is not; a source without a cut takes nothing more
    whole = rows.where(~F.coalesce(inside, F.lit(False))).select(*cols, (base + F.when(F.col(bucket) < F.col(of["cut"]), F.col(size)).otherwise(0)).alias(taken))
    order = Window.partitionBy(src, bucket).orderBy(key, tie, size).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col(of["before"]) + F.coalesce(F.sum(size).over(order), F.lit(0))
    part = rows.where(inside).withColumn(of["more"], F.greatest(F.lit(0).cast("long"), F.least(F.col(size), F.col(of["rest"]) - ahead))).select(*cols, (base + F.col(of["more"])).alias(taken))
    return whole.unionByName(part)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each is repeated as often as it is taken, a part of half a document or more counting as once; columns as in `docs`."""
    mixed = mix(docs, **how)
    size, _, _, taken = mixed.columns[-4:]
    copies = F.when(F.col(size) > 0, F.round(F.col(taken) / F.col(size))).otherwise(0).cast("int")
    (n,) = free_names(mixed, "copy")
    return mixed.withColumn(n, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).select(*docs.columns)


SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) END AS size,
         (CAST(('0x' || substr(md5(concat('{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
         greatest({FLOOR}::DOUBLE, coalesce(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))::DOUBLE / length(text)::DOUBLE END, 0.0::DOUBLE)) AS w
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS most, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM r),
t AS (SELECT source, source_size, least(most::DOUBLE, coalesce(max(CASE WHEN level <= most::DOUBLE / weight THEN level END) OVER (), 0.0::DOUBLE) * weight) AS target FROM l),
p AS (SELECT *, CAST(floor(target) AS BIGINT) AS due, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.due - p.epochs * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM k
"""
