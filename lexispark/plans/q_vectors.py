"""Pair-vector losses (V11-V17) and source/sink round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.keys import r6
from lexispark.operators import pairs as J
from lexispark.operators import vectors as V
from lexispark.plans.q_pairs import CON, contrastive
from lexispark.plans.q_tagging import split as tag_split
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx
from lexispark.sources import io as IO

_PV = f"""{CON}, pv as (select q1, q2, y::double as y, a.embedding::double[] as e1, b.embedding::double[] as e2,
  a.quote_id % 7 as batch
  from con join sense_items a on a.quote_id = q1 join sense_items b on b.quote_id = q2),
dl as (select *, list_distance(e1, e2) ^ 2 as d2, sqrt(greatest(list_distance(e1, e2) ^ 2, 1e-7)) as d,
  list_cosine_similarity(e1, e2) as cos from pv),
ls as (select *, 0.5 * (y * d2 + (1 - y) * greatest(1.0 - sqrt(d2 + 1e-9), 0) ^ 2) as contrastive,
  (1 - y) * d2 + y * greatest(1.0 - sqrt(d2), 0) ^ 2 as contrastive_inv,
  y * 0.5 * d * d + (1 - y) * greatest(1.0 - d, 0) ^ 2 as euclidean_loss,
  y * 0.25 * (1 - cos) ^ 2 + (1 - y) * greatest(0.4 - (1 - cos), 0) ^ 2 as cosine_loss from dl)"""


def losses(spark, sf):
    p = J.with_vectors(contrastive(spark, sf), fx.sense_items(spark, sf), "quote_id")
    return V.pair_losses(p.withColumn("batch", F.col("q1") % 7))


@register("pair_distances", f"""{_PV} select q1, q2, round(d2, 6) as d2, round(d, 6) as d, round(cos, 6) as cos from ls""")
def pair_distances(spark, sf):
    return losses(spark, sf).select("q1", "q2", r6("d2").alias("d2"), r6("d").alias("d"), r6("cos").alias("cos"))


@register("pair_losses", f"""{_PV} select q1, q2, round(contrastive, 6) as contrastive,
  round(contrastive_inv, 6) as contrastive_inv, round(euclidean_loss, 6) as euclidean_loss,
  round(cosine_loss, 6) as cosine_loss from ls""")
def pair_losses(spark, sf):
    return losses(spark, sf).select("q1", "q2", *[r6(c).alias(c) for c in
                                                   ("contrastive", "contrastive_inv", "euclidean_loss", "cosine_loss")])


@register("pair_mean_loss", f"""{_PV} select round(avg(contrastive), 6) as loss_pairs,
  round((select avg(m) from (select avg(contrastive) as m from ls group by batch)), 6) as loss_batches from ls""")
def pair_mean_loss(spark, sf):
    lo = losses(spark, sf)
    a = V.mean_loss(lo, "contrastive").withColumnRenamed("loss", "loss_pairs")
    b = V.mean_loss(lo, "contrastive", batch="batch").withColumnRenamed("loss", "loss_batches")
    return a.crossJoin(b).select(r6("loss_pairs").alias("loss_pairs"), r6("loss_batches").alias("loss_batches"))


_SETS = f"""{fx.duck_with('sense_items')},
mean as (select lemma, list(m order by i) as c from (select lemma, i, avg(x) as m from (
  select lemma, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from sense_items)
  group by lemma, i) group by lemma),
vs as (select 'before' as s, quote_id, sense, embedding::double[] as v from sense_items
  union all select 'after', quote_id, sense, list_transform(list_zip(embedding::double[], mean.c), lambda z: z[1] - z[2])
  from sense_items join mean using (lemma)),
un as (select s, quote_id, sense, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from vs
  where list_dot_product(v, v) > 0),
nb as (select s, q, hit, rk - 1 as pos from (select a.s, a.quote_id as q, (a.sense = b.sense)::int as hit, row_number() over (
    partition by a.s, a.quote_id order by list_dot_product(a.v, b.v) desc, b.quote_id) as rk
  from un a join un b on a.s = b.s) where rk between 2 and 20),
cm as (select *, sum(hit) over (partition by s, q order by pos) as cum from nb),
per as (select s, q, sum(hit) as got, coalesce(avg(case when hit = 1 then cum / pos end), 0) as ap from cm group by s, q),
sz as (select s, sense, count(*) as n from vs group by s, sense),
sc as (select vs.s, vs.sense, coalesce(ap, 0) as ap, coalesce(got, 0) / least(n, 20) as acc from vs join sz using (s, sense)
  left join per on per.s = vs.s and per.q = vs.quote_id),
lb as (select s, sense, avg(acc) as acc, avg(ap) as ap from sc group by s, sense)
select s as "set", round(avg(acc), 6) as micro_acc, round((select avg(acc) from lb where lb.s = sc.s), 6) as macro_acc,
  round(avg(ap), 6) as micro_ap, round((select avg(ap) from lb where lb.s = sc.s), 6) as macro_ap from sc group by s"""


@register("compare_vector_sets", _SETS)
def compare_vector_sets(spark, sf):
    si = fx.sense_items(spark, sf)
    orig = si.select("quote_id", "embedding").withColumn("set", F.lit("before"))
    # a data-derived transform: vectors centred on their lemma mean
    from lexispark.operators.senses import centroids
    mean = centroids(si, [], sense="lemma").select("lemma", "centroid")
    moved = si.join(mean, "lemma").select(
        "quote_id", F.zip_with(F.col("embedding").cast("array<double>"), "centroid", lambda a, b: a - b).alias("embedding"))
    sets = orig.withColumn("embedding", F.col("embedding").cast("array<double>")) \
        .unionByName(moved.withColumn("set", F.lit("after")))
    out = V.compare_vector_sets(sets, si.select("quote_id", "sense"), 20, "sense", id_col="quote_id")
    return out.select("set", *[r6(c).alias(c) for c in ("micro_acc", "macro_acc", "micro_ap", "macro_ap")])


# --- sources and sinks: write with our writers, read back with our readers ----------------------------

@register("io_quotes_tsv", f"{fx.duck_with('quotes')} select quote_id, lemma, word, numbering, quote, keyword, year, n_words from quotes")
def io_quotes_tsv(spark, sf):
    path = IO.scratch(spark, "quotes-tsv")
    IO.write_result(fx.quotes(spark, sf), path, "tsv")
    return IO.read_quotes(spark, path, sep="\t")


@register("io_pairs_tsv", f"{fx.duck_with('pairs')} select s1 as S1, s2 as S2, y1 as Y1, y2 as Y2 from pairs")
def io_pairs_tsv(spark, sf):
    path = IO.scratch(spark, "pairs-tsv")
    p = fx.pairs(spark, sf).select(F.col("s1").alias("S1"), F.col("s2").alias("S2"),
                                   F.col("y1").alias("Y1"), F.col("y2").alias("Y2"))
    IO.write_result(p, path, "tsv")
    return IO.read_pairs(spark, path)


@register("io_tagged_corpus", f"""{fx.duck_with('tagged')} select cast(sent_id as varchar) as id, len(tokens) as n_tokens,
  array_to_string(tokens, ' ') as tokens, array_to_string(tags, ' ') as tags, 0 as n_rejects from tagged""")
def io_tagged_corpus(spark, sf):
    t = fx.tagged(spark, sf)
    lines = F.concat(F.array(F.lit("<P_1>")),
                     F.transform(F.arrays_zip("tokens", "tags"), lambda z: F.concat(z["tokens"], F.lit("/"), z["tags"])),
                     F.array(F.concat(F.col("sent_id").cast("string"), F.lit("/ID"))))
    path = IO.scratch(spark, "tagged-text")
    t.select("source", F.array_join(lines, "\n").alias("value")) \
        .write.mode("overwrite").partitionBy("source").text(path)
    r = IO.read_tagged_corpus(spark, path + "/*/*")
    return r.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"),
                    F.array_join("pos_tags", " ").alias("tags"), F.size("rejects").alias("n_rejects"))


@register("io_sentences_json", f"""{fx.duck_with('tagged')} select cast(sent_id as varchar) as id, len(tokens) as n_tokens,
  array_to_string(tags, ' ') as labels, 'tokens' as text_col, 'pos_tags' as label_col from tagged""")
def io_sentences_json(spark, sf):
    t = fx.tagged(spark, sf).select(F.col("sent_id").cast("string").alias("id"), "tokens",
                                     F.col("tags").alias("pos_tags"), "source")
    path = IO.scratch(spark, "sentences-json")
    IO.write_result(t, path, "jsonl")
    df, text, label = IO.read_sentences(spark, path, "pos")
    return df.select("id", F.size(text).alias("n_tokens"), F.array_join(label, " ").alias("labels"),
                     F.lit(text).alias("text_col"), F.lit(label).alias("label_col"))


@register("io_vectors", f"""{fx.duck_with('sense_items')} select quote_id as id, round(list_sum(embedding::double[]), 6) as s,
  len(embedding) as d from sense_items""")
def io_vectors(spark, sf):
    path = IO.scratch(spark, "vectors")
    IO.write_vectors(fx.sense_items(spark, sf), path, "quote_id")
    v = IO.read_vectors(spark, path)
    return v.select("id", r6(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)).alias("s"),
                    F.size("embedding").alias("d"))


@register("io_scores_partitioned", f"""{fx.duck_with('scores')} select item_id, bg_id, round(score * 0.5, 6) as score,
  'backward' as direction from scores""")
def io_scores_partitioned(spark, sf):
    s = fx.scores(spark, sf)
    both = s.withColumn("model", F.lit("m1")).withColumn("direction", F.lit("forward")) \
        .unionByName(s.withColumn("score", F.col("score") * 0.5).withColumn("model", F.lit("m2"))
                     .withColumn("direction", F.lit("backward")))
    path = IO.scratch(spark, "scores")
    IO.write_scores(both, path)
    r = IO.read_scores(spark, path, model="m2")
    return r.select("item_id", "bg_id", r6("score").alias("score"), "direction")


@register("io_tag_lines", f"{fx.duck_with('tagged')} select array_to_string(preds, ' ') as value from tagged")
def io_tag_lines(spark, sf):
    path = IO.scratch(spark, "tag-lines")
    IO.write_tag_lines(fx.tagged(spark, sf), path, "preds")
    return spark.read.text(path)


@register("io_predictions", f"""{fx.duck_with('tagged')} select 'tagger' as model, 10 as max_support, sent_id,
  (generate_subscripts(preds, 1) - 1)::int as "index", unnest(preds) as pred from tagged""")
def io_predictions(spark, sf):
    t = fx.tagged(spark, sf).select("sent_id", F.posexplode("preds").alias("index", "pred"))
    path = IO.scratch(spark, "predictions")
    IO.write_predictions(t, path, model="tagger", max_support=10)
    return spark.read.parquet(path).select("model", "max_support", "sent_id", "index", "pred")


@register("io_write_if_absent", f"{fx.duck_with('pairs')} select pair_id from pairs")
def io_write_if_absent(spark, sf):
    path = IO.scratch(spark, "absent")
    p = fx.pairs(spark, sf)
    IO.write_if_absent(p.select("pair_id"), path)
    IO.write_if_absent(p.select((F.col("pair_id") * -1).alias("pair_id")), path)  # ignored: exists
    return spark.read.parquet(path)


@register("io_with_params", f"""{fx.duck_with('tagged')}, tr as (select * from tagged where
  md5(concat_ws(':', 'tagsplit', cast(sent_id as varchar))) < 'cccccccc')
select 'bigram' as model, 5 as max_support, count(*) as n_sentences from tr""")
def io_with_params(spark, sf):
    tr, _ = tag_split(spark, sf)
    rec = IO.with_params(tr.agg(F.count(F.lit(1)).alias("n_sentences")), model="bigram", max_support=5)
    path = IO.scratch(spark, "records")
    IO.write_result(rec, path, "jsonl")
    return spark.read.schema("n_sentences long, model string, max_support int").json(path) \
        .select("model", "max_support", "n_sentences")
