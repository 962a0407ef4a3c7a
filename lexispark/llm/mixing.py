"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate: target share x budget / size of the source.  A document
draws its count from the Poisson distribution with that mean by inverting it at a uniform number
hashed from (seed, key); the copies are exploded and shuffled globally by a second hash.

Defined cases: a null source is a source of its own; null and empty texts have size 0, and a
source of size 0 keeps rate 1; rows with equal keys (null keys too) draw equal counts, and those with
equal texts as well stand together in the global order; an input column named like an output column is
replaced, all other names are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, hash60, settle, unit

#: A rate is split into this much a draw at most: e^-8 is far from underflow and 60 terms are
#: the whole distribution in double precision.
PART, TERMS = 8.0, 60


def source_sizes(df: DataFrame, source: str, text: str) -> DataFrame:
    """Rows and bytes of each source (a few numbers a source leave each task)."""
    return df.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.octet_length(F.col(text)).cast("bigint")), F.lit(0)).alias("size"))


def rates(sizes: DataFrame, weights: Mapping[str, float] | None, temperature: float,
          epochs: float) -> DataFrame:
    """source, n_rows, size, weight (normalised), rate.

    ``weights``: target weight by source, sources not named weigh 0.  None: the share of the
    source raised to ``temperature`` (1 keeps the corpus as it is, 0 makes sources equal).
    ``epochs``: the budget in sizes of the whole corpus."""
    for w in (weights or {}).values():
        if not (math.isfinite(w) and w >= 0):
            raise ValueError("weights must be finite and not negative")
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(raw)
    sized = sizes.withColumn("raw", F.when(F.col("size") > 0, raw).otherwise(0.0))
    total = sized.agg(F.sum("raw"), F.sum("size")).first()
    all_raw, all_size = float(total[0] or 0.0), float(total[1] or 0)
    weight = F.col("raw") / F.lit(all_raw) if all_raw > 0 else F.lit(0.0)
    return (sized.withColumn("weight", weight)
            .withColumn("rate", F.when(F.col("size") > 0, F.col("weight") * F.lit(epochs * all_size)
                                       / F.col("size")).otherwise(F.lit(1.0)))
            .drop("raw"))


def cumulative(mean: Column) -> Column:
    """P(X <= k), k = 0, 1, ..., of a Poisson variable with a mean of at most PART."""
    def step(acc, k):
        return F.struct((acc["p"] * mean / (k + 1)).alias("p"), (acc["c"] + acc["p"]).alias("c"),
                        F.concat(acc["a"], F.array(acc["c"] + acc["p"])).alias("a"))
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("c"),
                     F.expr("cast(array() as array<double>)").alias("a"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step, lambda acc: acc["a"])


def poisson_counts(parts: Column, cdf: Column, draw) -> Column:
    """Sum over ``parts`` independent inversions; ``draw(j)`` is the j-th uniform number."""
    return F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0).cast("bigint"),
        lambda acc, j: acc + F.size(F.filter(cdf, lambda c: c <= draw(j))).cast("bigint"))


def mix_sources(df: DataFrame, weights: Mapping[str, float] | None = None, *,
                temperature: float = 0.5, epochs: float = 1.0, seed: int = 11,
                key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as drawn, with copy_no (from 1) and mix_key (the global
    random order: partitions are dealt by it and sorted by it)."""
    base = df.drop("copy_no", "mix_key")
    named, parts, cdf, n = fresh("source"), fresh("parts"), fresh("cdf"), fresh("n")
    told = rates(settle(source_sizes(base, source, text), "sizes"), weights, temperature, epochs) \
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    table = settle(told.select(F.col("source").alias(named), F.col("parts").alias(parts),
                               cumulative(F.col("rate") / F.col("parts")).alias(cdf)), "rates")
    counted = base.join(table, F.col(source).eqNullSafe(F.col(named)), "left").withColumn(
        n, poisson_counts(F.col(parts), F.col(cdf), lambda j: unit(f"{seed}:count", j, F.col(key))))
    copies = (counted.filter(F.col(n) > 0)
              .select(*base.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))
                      .alias("copy_no"))
              # the text is part of the key: rows without a key are dealt over all partitions too
              .withColumn("mix_key", hash60(f"{seed}:order", F.col(key), F.col("copy_no"),
                                            F.md5(F.coalesce(F.col(text), F.lit(""))))))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key", "copy_no")


#: The same by SQL, for the defaults above.
MIX_SQL = """
with sizes as (
  select source, sum(coalesce(strlen(text), 0)) as size from documents group by source),
shares as (
  select source, size, case when size > 0 then pow(size::double, 0.5) else 0 end as raw
  from sizes),
rated as (
  select source, case when size > 0 then
      raw / (select sum(raw) from shares) * (select sum(size) from shares) / size
    else 1.0 end as rate from shares),
parts as (
  select source, rate, greatest(1, ceil(rate / 8.0))::int as m from rated),
cdf as (
  select source, k, sum(exp(-rate / m) * pow(rate / m, k) / gamma(k + 1))
      over (partition by source order by k) as c
  from parts, range(60) t(k)),
draws as (
  select d.doc_id, d.source, j,
    ('0x' || substr(md5('11:count:' || j || ':' || d.doc_id), 1, 15))::bigint / 1152921504606846976.0
      as u
  from documents d join parts p on d.source is not distinct from p.source,
       unnest(range(1, p.m + 1)) t(j)),
counts as (
  select dr.doc_id, count(c.k) as n
  from draws dr left join cdf c on dr.source is not distinct from c.source and c.c <= dr.u
  group by dr.doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, copy_no,
  ('0x' || substr(md5('11:order:' || d.doc_id || ':' || copy_no || ':' || md5(coalesce(d.text, ''))), 1, 15))::bigint
    as mix_key
from documents d join counts n using (doc_id), unnest(range(1, n.n + 1)) t(copy_no)
"""
