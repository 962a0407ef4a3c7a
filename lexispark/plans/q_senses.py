"""Sense classification queries (C1-C11, C15-C18) on the sense_items stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.arrays import cosine, sq_norm, vscale
from lexispark.functions.keys import r6
from lexispark.operators import fewshot as W
from lexispark.operators import pairs as J
from lexispark.operators import sampling as S
from lexispark.operators import senses as C
from lexispark.operators.logistic import fit_lemma_logistic
from lexispark.plans.q_pairs import CON, contrastive
from lexispark.plans.q_sampling import episodes_sql, md5k
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx

SI = fx.duck_with("sense_items")
_ST = f"""st as (select *, case when row_number() over (partition by lemma, sense order by {md5k('strat', 'quote_id')},
  quote_id) <= least(count(*) over (partition by lemma, sense) - 1, greatest(1, ceil(count(*) over
  (partition by lemma, sense) * 0.5))) then 'train' else 'test' end as role from sense_items),
tr as (select * from st where role = 'train'), te as (select * from st where role = 'test')"""


def _cent_sql(src: str, keys: str) -> str:
    return f"""(select {keys}, list(m order by i) as centroid, max(n) as n_train from (
  select {keys}, i, avg(x) as m, count(*) as n from (
    select {keys}, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from {src})
  group by all) group by all)"""


CENT = f"cent as {_cent_sql('tr', 'lemma, sense')}"
NEAR = """nc as (select quote_id, lemma, gold, pred from (select te.quote_id, te.lemma, te.sense as gold, c.sense as pred,
  row_number() over (partition by te.quote_id order by list_cosine_similarity(te.embedding::double[], c.centroid) desc,
  c.sense desc) as k from te join cent c on c.lemma = te.lemma) where k = 1)"""
MAJ = """mj as (select te.quote_id, te.lemma, te.sense as gold, b.sense as pred from te join (select lemma, sense from (
  select lemma, sense, row_number() over (partition by lemma order by count(*) desc, sense) as k from tr group by lemma, sense)
  where k = 1) b on b.lemma = te.lemma)"""
FREQ = f"""fq as (select te.quote_id, te.lemma, te.sense as gold, d.sense as pred from te join (
  select lemma, sense, sum(c) over (partition by lemma order by sense) as hi,
    sum(c) over (partition by lemma order by sense) - c as lo, sum(c) over (partition by lemma) as tot
  from (select lemma, sense, count(*) as c from tr group by lemma, sense)) d on d.lemma = te.lemma
  where ({"('0x' || substr(" + md5k('freq', 'te.quote_id') + ", 1, 15))::bigint"}) % d.tot >= d.lo
    and ({"('0x' || substr(" + md5k('freq', 'te.quote_id') + ", 1, 15))::bigint"}) % d.tot < d.hi)"""
BASE = f"{SI}, {_ST}, {CENT}, {NEAR}"


def split(spark, sf):
    si = fx.sense_items(spark, sf)
    st = S.stratified_split(si, ["lemma", "sense"], 0.5, id_col="quote_id")
    return st.where("role = 'train'"), st.where("role = 'test'")


def nearest(spark, sf):
    tr, te = split(spark, sf)
    cents = C.centroids(tr, ["lemma"])
    p = C.nearest_centroid(te, cents, ["lemma"], "cosine", id_col="quote_id")
    return p.join(te.select("quote_id", F.col("sense").alias("gold")), "quote_id") \
        .select("quote_id", "lemma", "gold", "pred")


@register("wsd_centroids", f"""{SI}, {_ST}, {CENT} select lemma, sense, n_train, round(list_sum(centroid), 6) as csum,
  round(sqrt(list_dot_product(centroid, centroid)), 6) as cnorm from cent""")
def wsd_centroids(spark, sf):
    tr, _ = split(spark, sf)
    c = C.centroids(tr, ["lemma"])
    return c.select("lemma", "sense", "n_train",
                    r6(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)).alias("csum"),
                    r6(F.sqrt(sq_norm("centroid"))).alias("cnorm"))


@register("wsd_nearest_centroid", f"{BASE} select * from nc")
def wsd_nearest_centroid(spark, sf):
    return nearest(spark, sf)


@register("wsd_majority", f"{SI}, {_ST}, {MAJ} select * from mj")
def wsd_majority(spark, sf):
    tr, te = split(spark, sf)
    p = C.majority_baseline(tr, te, ["lemma"], id_col="quote_id")
    return p.join(te.select("quote_id", F.col("sense").alias("gold")), "quote_id") \
        .select("quote_id", "lemma", "gold", "pred")


@register("wsd_frequency", f"{SI}, {_ST}, {FREQ} select * from fq")
def wsd_frequency(spark, sf):
    tr, te = split(spark, sf)
    p = C.frequency_baseline(tr, te, ["lemma"], id_col="quote_id")
    return p.join(te.select("quote_id", F.col("sense").alias("gold")), "quote_id") \
        .select("quote_id", "lemma", "gold", "pred")


@register("wsd_results", f"""{BASE}, {MAJ}, {FREQ}
select 'centroid' as model, quote_id, lemma, gold, pred from nc
union all select 'majority', quote_id, lemma, gold, pred from mj
union all select 'random', quote_id, lemma, gold, pred from fq""")
def wsd_results(spark, sf):
    out = nearest(spark, sf).withColumn("model", F.lit("centroid"))
    out = out.unionByName(wsd_majority(spark, sf).withColumn("model", F.lit("majority")))
    out = out.unionByName(wsd_frequency(spark, sf).withColumn("model", F.lit("random")))
    return out.select("model", "quote_id", "lemma", "gold", "pred")


@register("wsd_class_index", f"""{SI}, {_ST} select lemma, sense, row_number() over (partition by lemma
  order by count(*) desc, sense) - 1 as class_idx from tr group by lemma, sense""")
def wsd_class_index(spark, sf):
    tr, _ = split(spark, sf)
    return C.class_index(tr, ["lemma"]).select("lemma", "sense", F.col("class_idx").cast("bigint"))


@register("wsd_query_not_covered", f"""{SI}, {_ST} select quote_id, lemma, sense from te
where not exists (select 1 from tr where tr.lemma = te.lemma and tr.sense = te.sense)""")
def wsd_query_not_covered(spark, sf):
    tr, te = split(spark, sf)
    v = C.query_not_covered(tr, te, ["lemma"])
    return v.select("quote_id", "lemma", "sense")


LS = "ls as (select lemma, avg((gold = pred)::int::double) as f1, count(*) as support from nc group by lemma)"


@register("wsd_lemma_scores", f"{BASE}, {LS} select lemma, round(f1, 6) as f1, support from ls")
def wsd_lemma_scores(spark, sf):
    s = C.lemma_scores(nearest(spark, sf), ["lemma"], true="gold")
    return s.select("lemma", r6("f1").alias("f1"), "support")


@register("wsd_aggregate", f"""{BASE}, {LS} select round(avg(f1), 6) as f1_micro,
  round(sum(f1 * support) / sum(support), 6) as f1_macro from ls""")
def wsd_aggregate(spark, sf):
    a = C.aggregate_scores(C.lemma_scores(nearest(spark, sf), ["lemma"], true="gold"))
    return a.select(r6("f1_micro").alias("f1_micro"), r6("f1_macro").alias("f1_macro"))


@register("wsd_per_class", f"""{BASE},
c as (select lemma, cls, sum(tp) as tp, sum(nt) as n_true, sum(np) as n_pred from (
  select lemma, gold as cls, (gold = pred)::int as tp, 1 as nt, 0 as np from nc
  union all select lemma, pred as cls, 0, 0, 1 from nc) group by lemma, cls)
select lemma, cls, cast(tp as bigint) as tp, cast(n_true as bigint) as n_true, cast(n_pred as bigint) as n_pred,
  round(case when n_pred > 0 then tp / n_pred else 0 end, 6) as precision,
  round(case when n_true > 0 then tp / n_true else 0 end, 6) as recall,
  round(case when tp > 0 then 2 * (tp / n_pred) * (tp / n_true) / (tp / n_pred + tp / n_true) else 0 end, 6) as f1
from c""")
def wsd_per_class(spark, sf):
    s = C.per_class_scores(nearest(spark, sf), ["lemma"], true="gold")
    return s.select("lemma", "cls", F.col("tp").cast("bigint"), F.col("n_true").cast("bigint"),
                    F.col("n_pred").cast("bigint"), r6("precision").alias("precision"),
                    r6("recall").alias("recall"), r6("f1").alias("f1"))


_LADDER_SIZES = [1, 2, 5, 10, 20, None]


@register("wsd_support_ladder", f"""{SI}, {_ST},
rk as (select *, row_number() over (partition by lemma, sense order by {md5k('ladder', 'quote_id')}, quote_id) as r from tr),
sz as (select * from (values (1, '1'), (2, '2'), (5, '5'), (10, '10'), (20, '20'), (null, 'all')) t(n, n_items)),
dr as (select rk.*, sz.n_items from rk join sz on n is null or r <= n),
cent as {_cent_sql('dr', 'n_items, lemma, sense')},
p as (select n_items, quote_id, gold, pred from (select c.n_items, te.quote_id, te.sense as gold, c.sense as pred,
  row_number() over (partition by c.n_items, te.quote_id order by list_cosine_similarity(te.embedding::double[], c.centroid) desc,
  c.sense desc) as k from te join cent c on c.lemma = te.lemma) where k = 1)
select n_items, round(avg((gold = pred)::int::double), 6) as accuracy, count(*) as n from p group by n_items""")
def wsd_support_ladder(spark, sf):
    tr, te = split(spark, sf)
    p = C.support_ladder(tr, te, ["lemma"], _LADDER_SIZES, id_col="quote_id")
    return p.groupBy("n_items").agg(r6(F.avg((F.col("gold") == F.col("pred")).cast("double"))).alias("accuracy"),
                                    F.count(F.lit(1)).alias("n"))


# --- few-shot, development and zero-shot evaluation -----------------------------------------------

_SIZES, _ITS = (1, 2, 5, 10, 15, 25), 20
_GONE = (3, 4, 5, 6)       # items without a vector in the second model


def items(spark, sf):
    return fx.sense_items(spark, sf).withColumn("pos", F.when(F.col("quote_id") % 2 == 0, "n").otherwise("v"))


def vectors(spark, sf):
    v = fx.sense_items(spark, sf).select("quote_id", F.col("embedding").cast("array<double>").alias("embedding"),
                                         (1 + F.col("quote_id") % 3).cast("int").alias("n_subtokens"))
    half = v.where(~F.col("quote_id").isin(list(_GONE))).withColumn("embedding", F.slice("embedding", 1, 16))
    return v.withColumn("model", F.lit("a")).unionByName(half.withColumn("model", F.lit("b")))


_FEW = f"""{SI},
el as (select *, case when quote_id % 2 = 0 then 'n' else 'v' end as pos from sense_items where (lemma, sense) in (
  select (lemma, sense) from (select lemma, sense, count(*) as c, count(*) over (partition by lemma) as k
    from sense_items group by lemma, sense having count(*) >= 2) where k > 1)),
st as (select *, case when row_number() over (partition by lemma, sense order by {md5k('strat', 'quote_id')},
  quote_id) <= least(count(*) over (partition by lemma, sense) - 1, greatest(1, ceil(count(*) over
  (partition by lemma, sense) * 0.5))) then 'train' else 'test' end as role from el),
tr as (select * from st where role = 'train'), te as (select * from st where role = 'test'),
rk as (select it.iteration, quote_id, lemma, sense, row_number() over (partition by it.iteration, lemma, sense
  order by {md5k('fewshot', 'it.iteration', 'quote_id')}, quote_id) as rn
  from tr, (select range::int as iteration from range({_ITS})) it),
dr as (select cast(n as varchar) as n_items, iteration, quote_id, lemma, sense
  from rk join (select unnest({list(_SIZES)}) as n) sz on rn <= n
  union all select 'full', 0, quote_id, lemma, sense from tr),
vec as (select quote_id, 'a' as model, embedding::double[] as embedding, (1 + quote_id % 3)::int as n_subtokens
  from sense_items union all select quote_id, 'b', embedding[1:16]::double[], (1 + quote_id % 3)::int
  from sense_items where quote_id not in {_GONE}),
whole as (select m.model, te.lemma from te cross join (select distinct model from vec) m
  left join vec on vec.quote_id = te.quote_id and vec.model = m.model
  group by m.model, te.lemma having bool_and(vec.quote_id is not null)),
dv as (select dr.*, vec.model, vec.embedding from dr join vec using (quote_id)),
cent as {_cent_sql('dv', 'model, lemma, n_items, iteration, sense')},
near as (select quote_id, model, lemma, n_items, iteration, pred, n_subtokens from (
  select te.quote_id, vec.model, te.lemma, c.n_items, c.iteration, c.sense as pred, vec.n_subtokens, row_number() over (
    partition by te.quote_id, vec.model, c.n_items, c.iteration
    order by list_cosine_similarity(vec.embedding, c.centroid) desc, c.sense desc) as k
  from te join vec using (quote_id) join whole on whole.model = vec.model and whole.lemma = te.lemma
    join cent c on c.lemma = te.lemma and c.model = vec.model) where k = 1),
cnt as (select lemma, n_items, iteration, sense, count(*) as c from dr group by all),
dim as (select *, row_number() over (partition by lemma, n_items, iteration order by c desc, sense) as k,
  sum(c) over (partition by lemma, n_items, iteration order by sense) as hi,
  sum(c) over (partition by lemma, n_items, iteration) as tot from cnt),
base as (select te.quote_id, te.lemma, d.n_items, d.iteration, d.sense, d.k, d.c, d.hi,
    ('0x' || substr({md5k('fewshot-random', 'd.n_items', 'd.iteration', 'te.quote_id')}, 1, 15))::bigint % d.tot as u
  from te join dim d on d.lemma = te.lemma where te.lemma in (select lemma from whole where model = 'a')),
res as (select quote_id, model, lemma, n_items, iteration, pred, n_subtokens from near
  union all select quote_id, 'majority', lemma, n_items, iteration, sense, null from base where k = 1
  union all select quote_id, 'random', lemma, n_items, iteration, sense, null from base where u < hi and u >= hi - c)"""


@register("wsd_fewshot_results", f"""{_FEW} select res.model, n_items, iteration, res.lemma, te.pos,
  count(*) as n, sum((pred = te.sense)::int)::bigint as n_right, sum(year)::bigint as years,
  coalesce(sum(n_subtokens), 0)::bigint as n_subtokens, min(pred) as first_pred, max(pred) as last_pred
from res join te using (quote_id) group by all""")
def wsd_fewshot_results(spark, sf):
    """Accuracy figures of the whole result table (its rows are compared by these sums)."""
    r = W.fewshot_results(items(spark, sf), vectors(spark, sf), _ITS, _SIZES, baseline_scope="a")
    by = ["model", "n_items", "iteration", "lemma", "pos"]
    # first by the prediction too: the smallest and largest of the texts are then sought among few rows
    told = r.groupBy(*by, "pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("true")).cast("bigint")).alias("n_right"),
        F.sum(F.col("year").cast("bigint")).alias("years"),
        F.coalesce(F.sum(F.col("n_subtokens").cast("bigint")), F.lit(0)).alias("n_subtokens"))
    return told.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_right", "years", "n_subtokens")],
        F.min("pred").alias("first_pred"), F.max("pred").alias("last_pred"))


def _nearest_sql(sup: str, qry: str, sizes) -> str:
    """Predictions by dot product for each support size (null: all rows)."""
    rows = ", ".join(f"({'null' if s is None else s}, '{'all' if s is None else s}')" for s in sizes)
    return f"""sr as (select *, row_number() over (partition by lemma, sense order by {md5k('support', 'quote_id')},
  quote_id) as rn from {sup}),
dv as (select sr.lemma, sr.sense, sr.embedding, z.size from sr join (values {rows}) z(n, size) on n is null or rn <= n),
cent as {_cent_sql('dv', 'size, lemma, sense')},
pr as (select quote_id, lemma, size, "true", pred from (select q.quote_id, q.lemma, c.size, q.sense as "true", c.sense as pred,
  row_number() over (partition by q.quote_id, c.size order by list_dot_product(q.embedding::double[], c.centroid) desc,
  c.sense desc) as k from {qry} q join cent c on c.lemma = q.lemma) where k = 1)"""


@register("wsd_evaluate_dev", f"""{SI}, {_ST}, {_nearest_sql('tr', 'te', [None])}
select quote_id, lemma, "true", pred from pr""")
def wsd_evaluate_dev(spark, sf):
    tr, te = split(spark, sf)
    return W.evaluate_dev(tr.drop("role"), te.drop("role")).select("quote_id", "lemma", "true", "pred")


_ZERO = f"""zk as (select *, count(*) over (partition by lemma, sense) as c from sense_items
  where lemma in (select lemma from (select distinct lemma from sense_items) order by {md5k('keys', 'lemma')}, lemma limit 50)),
zh as (select *, row_number() over (partition by lemma, sense order by {md5k('halves', 'quote_id')}, quote_id)
  <= least(c - 1, greatest(1, ceil(c * 0.5))) as sup from zk where c >= 2),
zs as (select * from zh where sup), zq as (select * from zh where not sup)"""


def zero_items(spark, sf):
    si = fx.sense_items(spark, sf)
    return si.join(S.sample_keys(si, "lemma", 50), "lemma", "left_semi")


@register("wsd_evaluate_zero", f"""{SI}, {_ZERO}, {_nearest_sql('zs', 'zq', [None])}
select quote_id, lemma, "true", pred from pr""")
def wsd_evaluate_zero(spark, sf):
    return W.evaluate_zero(zero_items(spark, sf)).select("quote_id", "lemma", "true", "pred")


@register("wsd_zero_ladder", f"""{SI}, {_ZERO}, {_nearest_sql('zs', 'zq', [1, 2, 5, 10, 20, None])}
select size as max_support, quote_id, lemma, "true", pred from pr""")
def wsd_zero_ladder(spark, sf):
    return W.evaluate_zero_ladder(zero_items(spark, sf), _LADDER_SIZES).select(
        "max_support", "quote_id", "lemma", "true", "pred")


@register("wsd_episode_loss", f"""{SI}, {episodes_sql('sense_items', 100, 'uniform', 30, 30)},
ev as (select ep.*, embedding from ep join sense_items using (quote_id)),
cent as {_cent_sql("(select * from ev where role = 'support')", 'episode, lemma, sense')},
z as (select q.episode, q.quote_id, q.sense = c.sense as hit, list_dot_product(q.embedding::double[], c.centroid) as z
  from ev q join cent c on c.episode = q.episode and c.lemma = q.lemma where q.role = 'query'),
m as (select episode, quote_id, max(z) as m from z group by episode, quote_id),
l as (select z.episode, z.quote_id, any_value(m) + ln(sum(exp(z - m))) - max(case when hit then z end) as loss
  from z join m using (episode, quote_id) group by z.episode, z.quote_id)
select episode, round(avg(loss), 6) as loss from l group by episode""")
def wsd_episode_loss(spark, sf):
    si = fx.sense_items(spark, sf)
    ep = S.sample_episodes(si, 100, id_col="quote_id", max_support=30, max_query=30)
    return C.episode_loss(ep, id_col="quote_id").select("episode", r6("loss").alias("loss"))


@register("lemma_logistic")
def lemma_logistic(spark, sf):
    """One logistic model per lemma on all contrastive pairs of its items (tested against numpy)."""
    si = fx.sense_items(spark, sf)
    p = J.with_vectors(contrastive(spark, sf), si, "quote_id")
    p = p.join(si.select(F.col("quote_id").alias("q1"), "lemma"), "q1").withColumn(
        "pair_id", F.concat_ws("-", "q1", "q2", "y"))
    fit = fit_lemma_logistic(p, label="y")
    return fit.select("lemma", "n", "converged", r6("objective").alias("objective"),
                      r6(F.sqrt(sq_norm("weight"))).alias("norm"), r6(F.get("weight", F.lit(0))).alias("first"))


# --- thresholds and pair scores -------------------------------------------------------------

@register("constant_baselines", f"""{CON}select round(avg(y::double), 6) as acc_all_1,
  round(avg((1 - y)::double), 6) as acc_all_0 from con""")
def constant_baselines(spark, sf):
    b = C.constant_baselines(contrastive(spark, sf), "y")
    return b.select(r6("acc_all_1").alias("acc_all_1"), r6("acc_all_0").alias("acc_all_0"))


@register("pair_best_threshold", f"""{CON},
s as (select y, (list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2 as score
  from con join sense_items a on a.quote_id = q1 join sense_items b on b.quote_id = q2),
t as (select range as i, range / 24.0 as th from range(25)),
acc as (select i, th, avg(((score >= th)::int = y)::int::double) as accuracy from t, s group by i, th)
select round(th, 6) as threshold, round(accuracy, 6) as accuracy from acc order by accuracy desc, i limit 1""")
def pair_best_threshold(spark, sf):
    p = J.with_vectors(contrastive(spark, sf), fx.sense_items(spark, sf), "quote_id")
    s = p.select("y", ((cosine("e1", "e2") + 1) / 2).alias("score"))
    b = C.best_threshold(s, "score", "y", n=25, lo=0.0, hi=1.0, strict=False)
    return b.select(r6("threshold").alias("threshold"), r6("accuracy").alias("accuracy"))


@register("dating_best_threshold", f"""{fx.duck_with('scores')},
s as (select score, (item_year > bg_year)::int as y from scores),
t as (select range as i, range / 49.0::double as th from range(50)),
acc as (select i, th, avg(((score > th)::int = y)::int::double) as accuracy from t, s group by i, th)
select round(th, 6) as threshold, round(accuracy, 6) as accuracy from acc order by accuracy desc, i limit 1""")
def dating_best_threshold(spark, sf):
    s = fx.scores(spark, sf).select("score", (F.col("item_year") > F.col("bg_year")).cast("int").alias("y"))
    b = C.best_threshold(s, "score", "y", n=50, strict=True)
    return b.select(r6("threshold").alias("threshold"), r6("accuracy").alias("accuracy"))


@register("pair_bce", f"""{CON},
lm as (select lemma, list_transform(centroid, lambda x: x * 0.1) as w0 from {_cent_sql('(select lemma, embedding from sense_items)', 'lemma')}),
s as (select y, 1 / (1 + exp(-list_dot_product(list_concat(a.embedding::double[], b.embedding::double[]),
  list_concat(lm.w0, lm.w0)))) as p from con join sense_items a on a.quote_id = q1 join sense_items b on b.quote_id = q2
  join lm on lm.lemma = a.lemma)
select round(avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6)
  as bce, round(avg(p), 6) as mean_p from s""")
def pair_bce(spark, sf):
    si = fx.sense_items(spark, sf)
    lm = C.centroids(si.withColumn("_one", F.lit("x")), [], sense="lemma") \
        .select("lemma", F.concat(vscale("centroid", 0.1), vscale("centroid", 0.1)).alias("weight"))
    p = J.with_vectors(contrastive(spark, sf), si, "quote_id")
    p = p.join(si.select(F.col("quote_id").alias("q1"), "lemma"), "q1")
    sc = C.bilinear_scores(p, lm)
    out = C.bce(sc, "p", "y").crossJoin(sc.agg(F.avg("p").alias("mean_p")))
    return out.select(r6("bce").alias("bce"), r6("mean_p").alias("mean_p"))

