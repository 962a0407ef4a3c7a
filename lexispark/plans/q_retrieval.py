"""Retrieval queries (V3-V10) on the sense_items stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.arrays import l2_normalize
from lexispark.functions.keys import r6
from lexispark.operators import knn as K
from lexispark.operators.ivf import recall, unpacked
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx
from lexispark.sources.io import settle

K_NEIGHBOURS = 50

# DuckDB: exact neighbours by brute force over all pairs (the oracle may be quadratic).
_NB = f"""
unit as (select quote_id, lemma, sense,
           list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v
         from sense_items),
nb as (select q, n, sim, rnk from (
         select a.quote_id as q, b.quote_id as n, list_dot_product(a.v, b.v) as sim,
           row_number() over (partition by a.quote_id order by list_dot_product(a.v, b.v) desc, b.quote_id) as rnk
         from unit a, unit b) where rnk <= {K_NEIGHBOURS})"""


def _retrieval_sql(label: str) -> str:
    return f"""{fx.duck_with('sense_items')}, {_NB},
lab as (select quote_id, {label} as l from sense_items),
sz as (select l, count(*) as nNeighbors from lab group by l),
h as (select nb.q, nb.rnk - 1 as pos, (lq.l = ln.l)::int as hit from nb
      join lab lq on lq.quote_id = nb.q join lab ln on ln.quote_id = nb.n where nb.rnk > 1),
c as (select q, pos, hit, sum(hit) over (partition by q order by pos) as cum from h),
per as (select q, sum(hit) as retrieved, avg(case when hit = 1 then cum / pos end) as ap from c group by q)
select lab.quote_id as qid, lab.l as {label}, sz.nNeighbors,
  cast(coalesce(per.retrieved, 0) as bigint) as retrieved,
  round(coalesce(per.ap, 0), 6) as ap,
  round(coalesce(per.retrieved, 0) / least(sz.nNeighbors, {K_NEIGHBOURS}), 6) as accuracy
from lab join sz on lab.l = sz.l left join per on per.q = lab.quote_id"""


def _neighbours(spark, sf_dir, carry=("lemma", "sense")):
    items = fx.sense_items(spark, sf_dir)
    return items, K.knn(items, K_NEIGHBOURS, id_col="quote_id", metric="cosine", carry=carry)


@register("vector_l2_normalize", f"""{fx.duck_with('sense_items')}
select quote_id,
  round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm,
  round(list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[])))[1], 6) as first_unit,
  round(list_sum(list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[])))), 6) as sum_unit
from sense_items""")
def vector_l2_normalize(spark, sf_dir):
    items = fx.sense_items(spark, sf_dir)
    u = l2_normalize("embedding")
    from lexispark.functions.arrays import sq_norm
    return items.select("quote_id", r6(F.sqrt(sq_norm("embedding"))).alias("norm"),
                        r6(F.element_at(u, 1)).alias("first_unit"),
                        r6(F.aggregate(u, F.lit(0.0), lambda a, x: a + x)).alias("sum_unit"))


@register("knn_neighbors", f"""{fx.duck_with('sense_items')}, {_NB}
select q as qid, cast(rnk as int) as rank, n as nid, round(sim, 6) as sim from nb""")
def knn_neighbors(spark, sf_dir):
    _, nb = _neighbours(spark, sf_dir, carry=())
    return nb.select("qid", "rank", "nid", r6("sim").alias("sim"))


@register("knn_approx")
def knn_approx(spark, sf_dir):
    """Neighbours by the inverted-file index, with each query's recall against the exact search."""
    items, exact = _neighbours(spark, sf_dir, carry=())
    found = settle(K.knn_approx(items, K_NEIGHBOURS, id_col="quote_id", packed=True), "knn-approx")
    told = unpacked(recall(found, exact), "recall")
    return told.select("qid", "rank", "nid", r6("sim").alias("sim"), r6("recall").alias("recall"))


@register("retrieval_by_lemma", _retrieval_sql("lemma"))
def retrieval_by_lemma(spark, sf_dir):
    items, nb = _neighbours(spark, sf_dir)
    s = K.retrieval_scores(nb, items.select("quote_id", "lemma"), K_NEIGHBOURS, "lemma",
                           id_col="quote_id")
    return K.rounded(s, "ap", "accuracy")


@register("retrieval_by_sense", _retrieval_sql("sense"))
def retrieval_by_sense(spark, sf_dir):
    items, nb = _neighbours(spark, sf_dir)
    s = K.retrieval_scores(nb, items.select("quote_id", "sense"), K_NEIGHBOURS, "sense",
                           id_col="quote_id")
    return K.rounded(s, "ap", "accuracy")


def _summary_sql() -> str:
    body = _retrieval_sql("lemma").split("\nselect lab.quote_id")[0]
    return f"""{body},
s as (select lab.l as lemma, coalesce(per.retrieved, 0) / least(sz.nNeighbors, {K_NEIGHBOURS}) as accuracy,
        coalesce(per.ap, 0) as ap
      from lab join sz on lab.l = sz.l left join per on per.q = lab.quote_id),
g as (select lemma, avg(accuracy) as a, avg(ap) as p from s group by lemma)
select round((select avg(accuracy) from s), 6) as micro_acc, round(avg(a), 6) as macro_acc,
  round((select avg(ap) from s), 6) as micro_ap, round(avg(p), 6) as macro_ap, 'lemma' as key
from g"""


@register("retrieval_summary", _summary_sql())
def retrieval_summary(spark, sf_dir):
    items, nb = _neighbours(spark, sf_dir)
    s = K.retrieval_scores(nb, items.select("quote_id", "lemma"), K_NEIGHBOURS, "lemma",
                           id_col="quote_id")
    return K.rounded(K.micro_macro(s, "lemma"), "micro_acc", "macro_acc", "micro_ap", "macro_ap")


def _expected_sql(label: str, pool: str) -> str:
    return f"""{fx.duck_with('sense_items')},
x as (select quote_id, {label} as l, {pool} as w from sense_items),
c as (select quote_id, l, count(*) over (partition by w, l) as n, count(*) over (partition by w) as npool from x)
select quote_id, l as {{name}}, n as nNeighbors, round(least({K_NEIGHBOURS}, npool) * n / npool, 6) as exp_retrieved,
  round(least({K_NEIGHBOURS}, npool) * n / npool / least(n, {K_NEIGHBOURS}), 6) as exp_accuracy from c"""


def _expected(items, label, within):
    e = K.random_baseline_expected(items, label, K_NEIGHBOURS, within=within, id_col="quote_id")
    return K.rounded(e, "exp_retrieved", "exp_accuracy")


@register("random_baseline_expected", _expected_sql("sense", "lemma").format(name="sense"))
def random_baseline_expected(spark, sf_dir):
    return _expected(fx.sense_items(spark, sf_dir), "sense", "lemma")


@register("random_baseline_whole_table", _expected_sql("lemma", "1").format(name="lemma"))
def random_baseline_whole_table(spark, sf_dir):
    return _expected(fx.sense_items(spark, sf_dir), "lemma", None)


@register("random_baseline_shared_labels", _expected_sql("split_part(sense, '+', 2)", "lemma").format(name="kind"))
def random_baseline_shared_labels(spark, sf_dir):
    """A label that several pools share: only the pool's own rows count."""
    items = fx.sense_items(spark, sf_dir).withColumn("kind", F.substring_index("sense", "+", -1))
    return _expected(items, "kind", "lemma")


@register("random_baseline_sampled")
def random_baseline_sampled(spark, sf_dir):
    items = fx.sense_items(spark, sf_dir)
    b = K.random_baseline(items, "lemma", K_NEIGHBOURS, id_col="quote_id")
    return K.rounded(b, "ap", "accuracy")
