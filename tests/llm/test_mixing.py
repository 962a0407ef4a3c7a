import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lexispark.llm import mixing
from lexispark.sources.tables import table


def brute(rows, temperature=0.5, seed=11):
    """Copies of each key by plain Python."""
    size = collections.Counter()
    for key, source, text in rows:
        size[source] += len((text or "").encode())
    raw = {s: n ** temperature if n else 0.0 for s, n in size.items()}
    total, everything = sum(raw.values()), sum(size.values())
    out = []
    for key, source, _ in rows:
        rate = raw[source] / total * everything / size[source] if size[source] else 1.0
        parts = max(1, math.ceil(rate / 8))
        n = 0
        for j in range(1, parts + 1):
            name = f"{seed}:count:{j}:{'\\N' if key is None else key}"
            u = int(hashlib.md5(name.encode()).hexdigest()[:15], 16) / 2 ** 60
            p, c = math.exp(-rate / parts), 0.0
            for k in range(60):
                c += p
                if u < c:
                    break
                n, p = n + 1, p * rate / parts / (k + 1)
        out.append((key, n))
    return out


def test_counts_equal_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.source, r.text) for r in odd_docs.collect()]
    want = collections.Counter()
    for key, n in brute(rows):
        want[key] += n
    got = collections.Counter(r.doc_id for r in mixing.mix_sources(odd_docs).collect())
    assert got == +want


def test_means_follow_the_weights(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "rare").otherwise("rest")
        .alias("source"))
    weights = {"hot": 1.0, "rare": 1.0, "rest": 2.0}
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, weights).groupBy("source").count()
         .collect()}
    for s, w in weights.items():
        want = 6000 * w / 4
        assert abs(n[s] - want) < 4 * math.sqrt(want)      # rare: rate 25, drawn in four parts


def test_order_is_global_and_does_not_depend_on_partitions(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    a = mixing.mix_sources(docs.repartition(7))
    b = mixing.mix_sources(docs.coalesce(1))
    assert sorted(a.select("doc_id", "copy_no", "mix_key").collect()) == sorted(
        b.select("doc_id", "copy_no", "mix_key").collect())
    for part in a.select("mix_key").rdd.glom().collect():
        assert part == sorted(part)


def test_edges(no_docs, odd_docs, clash):
    assert mixing.mix_sources(no_docs).count() == 0
    got = mixing.mix_sources(clash(odd_docs))
    assert dict(got.dtypes)["copy_no"] == "bigint" and got.count() > 0
    assert mixing.mix_sources(odd_docs, {"a": 1.0}).filter("source = 'b'").count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(odd_docs, {"a": -1.0})


def test_plan_has_no_python(odd_docs):
    plan = mixing.mix_sources(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_rows_without_a_key_are_dealt_over_all_partitions(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(
        F.lit("text "), F.col("id")).alias("text"), F.lit("a").alias("source"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mix_sources(docs, {"a": 1.0}, epochs=6.0).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)


def test_names_of_the_inside_are_free(odd_docs):
    names = ["__source", "__cdf", "__parts", "__n", "source_", "size", "rate", "n_rows"]
    docs = odd_docs
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    got = mixing.mix_sources(docs)
    assert all(r[n] == n for r in got.collect() for n in names)
    assert got.count() == mixing.mix_sources(odd_docs).count()
