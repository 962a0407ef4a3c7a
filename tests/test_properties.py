"""Invariants: partitioning independence, split disjointness, plan shapes, streaming."""

from pyspark.sql import functions as F

from lexispark.operators import pairs as J
from lexispark.operators import sampling as S
from lexispark.sources import fixtures as fx
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sampling_ignores_partitioning(spark):
    q = fx.quotes(spark, SF001).select("quote_id", "lemma", "year")
    base = _rows(S.sample_per_group(q, "lemma", 3, id_col="quote_id"))
    for n in (1, 7):
        again = _rows(S.sample_per_group(q.repartition(n), "lemma", 3, id_col="quote_id"))
        assert again == base


def test_exact_split_partitions_input(spark):
    q = fx.quotes(spark, SF001).select("quote_id")
    s = S.split_by_fraction(q, "quote_id", exact=True)
    counts = {r["role"]: r["count"] for r in s.groupBy("role").count().collect()}
    n = q.count()
    assert sum(counts.values()) == n and counts["train"] == int(0.9 * n)
    assert s.select("quote_id").distinct().count() == n


def test_stratified_split_covers_test_senses(spark):
    q = fx.quotes(spark, SF001).select("quote_id", "lemma", F.col("numbering").alias("sense"))
    el = S.eligible_senses(q)
    st = S.stratified_split(el, ["lemma", "sense"], id_col="quote_id")
    tr, te = st.where("role = 'train'"), st.where("role = 'test'")
    assert te.join(tr.select("lemma", "sense").distinct(), ["lemma", "sense"], "left_anti").count() == 0


def test_sense_pairs_no_self_and_labels(spark):
    q = fx.quotes(spark, SF001).select("quote_id", "lemma", F.substring("numbering", 1, 1).alias("sense"))
    p = J.sense_pairs(q, "lemma", "sense", "quote_id")
    assert p.where("q1 = q2").count() == 0
    j = p.join(q.select(F.col("quote_id").alias("q1"), F.col("sense").alias("s1")), "q1") \
        .join(q.select(F.col("quote_id").alias("q2"), F.col("sense").alias("s2")), "q2")
    assert j.where("(label = 1) != (s1 = s2)").count() == 0
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_window_group_limit_in_plan(spark):
    q = fx.quotes(spark, SF001).select("quote_id", "lemma")
    plan = S.sample_per_group(q, "lemma", 5, id_col="quote_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_no_python_udf_in_lexicon_plan(spark):
    from lexispark.operators.lexicon import prepare_lexicon
    plan = prepare_lexicon(fx.quotes(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_registered_queries_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0 <= rows[0]["micro_acc"] <= 1
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 100


def test_dating_queries_have_rows(spark):
    """None of the queries over scores compares nothing with nothing at the smallest size."""
    import __spark_entry__ as E
    qs = E.queries()
    for name in ("cross_with_background", "cross_backward", "score_background", "cumulative_curve", "knee_raw",
                 "knee_polynomial", "date_sentences", "dating_mae", "dating_mae_long", "dating_best_threshold",
                 "dating_model_thresholds", "background_curve", "background_curve_polynomial",
                 "io_scores_partitioned", "span_product", "knn_approx", "lemma_logistic", "compare_vector_sets"):
        assert qs[name](spark, SF001).limit(1).count() == 1, name


def test_a_hot_group_is_dealt_over_tasks(spark):
    """Rows of one group meet its size, or its dimension row, under several salts."""
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, "hot").otherwise(
        F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    dim = df.groupBy("g").agg(F.count("*").alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.join_dim(df, dim, "g").withColumn("p", F.spark_partition_id())
        assert out.count() == 4000 and out.where("g = 'hot' and n = 3000").select("p").distinct().count() >= 4
        assert S.join_dim(df, dim.where("g = 'hot'"), "g", "left_semi").count() == 3000
        assert S.join_dim(df, dim.where("g = 'hot'"), "g", "left_anti").count() == 1000
        sized = S.with_group_size(df.withColumn("g", F.nullif("g", F.lit("g7"))), "g")
        assert sized.count() == 4000 and sized.where("g is null and n = 20").count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_streaming_map_only(spark, tmp_path):
    from lexispark.functions.text import first_pos
    from lexispark.streaming.maponly import stream_map
    src = str(tmp_path / "src")
    fx.quotes(spark, SF001).select("quote_id", "word").write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = stream_map(spark, src, schema, lambda d: d.withColumn("pos", first_pos("word")), str(tmp_path / "out"))
    got = spark.read.parquet(out)
    assert got.count() == spark.read.parquet(src).count()
    assert got.where("pos is null").count() == 0


def test_episodes_bounded_and_covered(spark):
    q = fx.quotes(spark, SF001).select("quote_id", "lemma", F.substring("numbering", 1, 1).alias("sense"))
    ep = S.sample_episodes(q, 30, id_col="quote_id", max_support=6, max_query=4).cache()
    sizes = {(r["episode"], r["role"]): r["count"] for r in ep.groupBy("episode", "role").count().collect()}
    assert all(c <= (6 if role == "support" else 4) for (_, role), c in sizes.items())
    sup = ep.where("role = 'support'").select("episode", "sense").distinct()
    assert ep.where("role = 'query'").join(sup, ["episode", "sense"], "left_anti").count() == 0
    assert ep.groupBy("episode", "quote_id").count().where("count > 1").count() == 0
    assert ep.select("episode").distinct().count() == 30
