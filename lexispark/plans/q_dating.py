"""Sentence dating queries (D1-D13) on the pairs / scores / sense_items stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.keys import r6, seeded_int
from lexispark.operators import dating as D
from lexispark.operators import senses as C
from lexispark.plans.q_sampling import md5k
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx
from lexispark.sources.io import settle

SPAN = 50
CUTS = [-2.25 + 0.5 * i for i in range(9)]
UNP = """u as (select pair_id, 1 as side, s1 as text, y1 as year from pairs
  union all select pair_id, 2, s2, y2 from pairs),
ub as (select *, cast(floor(year / 50) * 50 as int) as bin from u),
mp as (select bin, row_number() over (order by bin) - 1 as class_id from (select distinct bin from ub))"""
P = fx.duck_with("pairs")


def unpivoted(spark, sf):
    return D.unpivot_pairs(fx.pairs(spark, sf), SPAN)


@register("unpivot_pairs", f"{P}, {UNP} select pair_id, side, text, year, bin from ub")
def unpivot_pairs(spark, sf):
    return unpivoted(spark, sf).select("pair_id", "side", "text", "year", "bin")


@register("ordinal_ids", f"{P}, {UNP} select bin, class_id from mp")
def ordinal_ids(spark, sf):
    m = D.ordinal_ids(unpivoted(spark, sf))
    return m.select("bin", F.col("class_id").cast("bigint"))


def _preds(spark, sf):
    u = unpivoted(spark, sf)
    m = D.ordinal_ids(u)
    k = m.agg(F.count(F.lit(1)).alias("_K"))
    j = u.join(F.broadcast(m), "bin").crossJoin(F.broadcast(k))
    shift = F.pmod(seeded_int("pred", "pair_id", "side"), F.lit(3)) - 1
    j = j.withColumn("pred_class", F.greatest(F.lit(0), F.least(F.col("_K") - 1, F.col("class_id") + shift)))
    return j, m


_PRED = f"""pr as (select ub.*, mp.class_id, greatest(0, least(k - 1, class_id +
  ({"('0x' || substr(" + md5k('pred', 'pair_id', 'side') + ", 1, 15))::bigint"}) % 3 - 1)) as pred_class
  from ub join mp on ub.bin = mp.bin, (select count(*) as k from mp))"""


@register("dating_scores", f"""{P}, {UNP}, {_PRED}
select round(avg((pred_class = pr.class_id)::int::double), 6) as accuracy,
  round(avg(abs(m2.bin + 25.0 - year)), 6) as mae from pr left join mp m2 on m2.class_id = pr.pred_class""")
def dating_scores(spark, sf):
    j, m = _preds(spark, sf)
    s = D.dating_scores(j, m, SPAN)
    return s.select(r6("accuracy").alias("accuracy"), r6("mae").alias("mae"))


@register("ordinal_loss", f"""{P}, {UNP}, z as (select ub.year, mp.class_id, (ub.year - 1700) / 100.0 as z from ub
  join mp on ub.bin = mp.bin),
cp as (select {CUTS} as c)
select round(avg(-ln(greatest(
  (case when class_id >= 9 then 1.0 else 1 / (1 + exp(-(c[class_id + 1] - z))) end) -
  (case when class_id <= 0 then 0.0 else 1 / (1 + exp(-(c[greatest(class_id, 1)] - z))) end), 1e-7))), 6) as loss
from z, cp""")
def ordinal_loss(spark, sf):
    u = unpivoted(spark, sf)
    m = D.ordinal_ids(u)
    z = u.join(F.broadcast(m), "bin").withColumn("z", (F.col("year") - 1700) / 100.0)
    return D.ordinal_loss(z, CUTS).agg(r6(F.avg("loss")).alias("loss"))


@register("background_pool", f"{fx.duck_with('drawn_pool')}select bg_id, bg_year from drawn_pool")
def background_pool(spark, sf):
    return fx.drawn_pool(spark, sf)


S = fx.duck_with("scores")


def _knee_sql(src: str, keys: str, val: str = "score") -> str:
    return f"""
cv as (select {keys}, bg_id, bg_year, sum({val}) over (partition by {keys} order by bg_year, bg_id
  rows between unbounded preceding and current row) as curve from {src}),
kn as (select *, min(bg_year) over w as x0, max(bg_year) over w as x1, min(curve) over w as y0, max(curve) over w as y1
  from cv window w as (partition by {keys})),
dd as (select {keys}, bg_id, bg_year, case when x1 > x0 and y1 > y0 then (curve - y0) / (y1 - y0) -
  (bg_year - x0) / (x1 - x0) end as d from kn),
kk as (select {keys}, max(case when k = 1 and d is not null then bg_year end) as knee from (
  select *, row_number() over (partition by {keys} order by d desc nulls last, bg_year, bg_id) as k from dd) group by all)"""


@register("cumulative_curve", f"""{S}select item_id, bg_id, round(sum(score) over (partition by item_id
  order by bg_year, bg_id rows between unbounded preceding and current row), 6) as curve from scores""")
def cumulative_curve(spark, sf):
    c = D.cumulative_curve(fx.scores(spark, sf), ["item_id"])
    return c.select("item_id", "bg_id", r6("curve").alias("curve"))


@register("knee_raw", f"{S}, {_knee_sql('scores', 'item_id')} select item_id, knee from kk")
def knee_raw(spark, sf):
    return D.date_items(fx.scores(spark, sf))


_THR = """s0 as (select score, (item_year > bg_year)::int as y from scores),
t as (select range as i, range / 49.0::double as th from range(50)),
acc as (select i, th, avg(((score > th)::int = y)::int::double) as a from t, s0 group by i, th),
best as (select th from acc order by a desc, i limit 1),
sth as (select scores.*, (score > (select th from best))::int::double as hit from scores)"""


def settled(spark, sf):
    """The stand-in's scores, computed once."""
    return settle(fx.scores(spark, sf), "scores")


def _both(spark, sf):
    k = D.date_sentences(settled(spark, sf), models=[])
    return k.withColumn("model", F.when(F.col("kind") == "raw", "raw").otherwise("thr"))


_KNEES = f"""{S}, {_THR}, {_knee_sql('scores', 'item_id').replace('kk as', 'kr as').strip()},
{_knee_sql('sth', 'item_id', 'hit').replace('cv as', 'cv2 as').replace('from cv ', 'from cv2 ').replace('kn as', 'kn2 as')
 .replace('from kn)', 'from kn2)').replace('dd as', 'dd2 as').replace('from dd)', 'from dd2)').strip()},
knees as (select item_id, knee, 'raw' as model from kr union all select item_id, knee, 'thr' from kk)"""


@register("date_sentences", f"""{_KNEES} select item_id, model, knee from knees""")
def date_sentences(spark, sf):
    return _both(spark, sf).select("item_id", "model", "knee")


@register("dating_mae", f"""{_KNEES},
ok as (select item_id, bool_and(knee is not null) as ok from knees group by item_id),
tr as (select distinct item_id, item_year from scores)
select model, round(avg(case when ok then abs(knee - item_year) end), 6) as mae,
  cast(sum(ok::int) as bigint) as n_items, cast(sum((knee is null)::int) as bigint) as n_missing
from knees join ok using (item_id) join tr using (item_id) group by model""")
def dating_mae(spark, sf):
    k = _both(spark, sf)
    m = D.mae(k.drop("item_year"), fx.scored_items(spark, sf), ["model"])
    return m.select("model", r6("mae").alias("mae"), F.col("n_items").cast("bigint"),
                    F.col("n_missing").cast("bigint"))


@register("dating_mae_long", f"""{_KNEES},
ok as (select item_id, bool_and(knee is not null) as ok from knees group by item_id),
tr as (select distinct item_id, item_year from scores)
select model, round(avg(case when ok then abs(knee - item_year) end), 6) as mae
from knees join ok using (item_id) join tr using (item_id) group by model""")
def dating_mae_long(spark, sf):
    k = _both(spark, sf)
    m = D.mae(k.drop("item_year"), fx.scored_items(spark, sf), ["model"])
    # a literal key: without items there is no row, as in the oracle
    wide = m.withColumn("_one", F.lit(1)).groupBy("_one").pivot("model", ["raw", "thr"]).agg(F.first("mae"))
    return D.melt(wide, ["_one"], ["raw", "thr"]).select(
        "model", r6("mae").alias("mae"))


_SIZES, _ITS = tuple(range(10, 101, 10)), 10


def two_models(spark, sf):
    """The scores of two models: the stand-in's own and a flatter one."""
    s = settled(spark, sf)
    return s.withColumn("model", F.lit("a")).unionByName(s.withColumn("model", F.lit("b")).withColumn(
        "score", F.col("score") * F.col("score")))


def _model_thresholds(s):
    return C.best_threshold(s.select("model", "score", (F.col("item_year") > F.col("bg_year")).cast("int")
                                     .alias("y")), "score", "y", n=50, strict=True, by=["model"])


_TWO = """two as (select *, 'a' as model from scores
  union all select item_id, bg_id, item_year, bg_year, score * score as score, 'b' as model from scores),
t as (select range as i, range / 49.0::double as th from range(50)),
acc as (select model, i, th, avg(((score > th)::int = (item_year > bg_year)::int)::int::double) as a
  from t, two group by model, i, th),
best as (select model, th, a from acc qualify row_number() over (partition by model order by a desc, i) = 1)"""


@register("dating_model_thresholds", f"""{S}, {_TWO} select model, round(th, 6) as threshold,
  round(a, 6) as accuracy from best""")
def dating_model_thresholds(spark, sf):
    b = _model_thresholds(two_models(spark, sf))
    return b.select("model", r6("threshold").alias("threshold"), r6("accuracy").alias("accuracy"))


@register("background_curve", f"""{S}, {_TWO},
bgp as (select bg_id, bg_year, cast(floor(bg_year / 50) * 50 as int) as b from drawn_pool),
rk as (select it.iteration, bgp.bg_id, row_number() over (partition by it.iteration, bgp.b
  order by {md5k('bgcurve', 'it.iteration', 'bgp.bg_id')}, bgp.bg_id) as r
  from bgp, (select range::int as iteration from range({_ITS})) it),
dr as (select sz.n, rk.iteration, rk.bg_id from rk join (select unnest({list(_SIZES)}) as n) sz on rk.r <= sz.n),
vals as (select two.*, 'raw' as kind, score as v from two
  union all select two.*, 'threshold' as kind, (score > th)::int::double as v from two join best using (model)),
sc as (select dr.n, dr.iteration, vals.* from vals join dr on dr.bg_id = vals.bg_id),
{_knee_sql('sc', 'n, iteration, kind, model, item_id', 'v').strip()},
ok as (select n, iteration, kind, item_id, bool_and(knee is not null) as ok from kk group by all),
tr as (select distinct item_id, item_year from scores)
select n, iteration, kind, model, round(avg(case when ok then abs(knee - item_year) end), 6) as mae,
  cast(sum(ok::int) as bigint) as n_items, cast(sum((knee is null)::int) as bigint) as n_missing
from kk join ok using (n, iteration, kind, item_id) join tr using (item_id) group by n, iteration, kind, model""")
def background_curve(spark, sf):
    s = two_models(spark, sf)
    out = D.background_curve(s, fx.drawn_pool(spark, sf), _SIZES, _ITS, thresholds=_model_thresholds(s),
                             method="chord")
    return out.select("n", "iteration", "kind", "model", r6("mae").alias("mae"),
                      F.col("n_items").cast("bigint"), F.col("n_missing").cast("bigint"))


@register("background_curve_polynomial")
def background_curve_polynomial(spark, sf):
    """The same with the knee of a polynomial fit, which SQL has no form of (tested by brute force)."""
    s = two_models(spark, sf)
    out = D.background_curve(s, fx.drawn_pool(spark, sf), _SIZES, _ITS, thresholds=_model_thresholds(s))
    return out.select("n", "iteration", "kind", "model", r6("mae").alias("mae"),
                      F.col("n_items").cast("bigint"), F.col("n_missing").cast("bigint"))


@register("knee_polynomial")
def knee_polynomial(spark, sf):
    return D.date_items(fx.scores(spark, sf), method="polynomial")


# token-level stand-in: each vector read as tokens of 8 dimensions, all of them
TOK = f"""{fx.duck_with('sense_items')}, tok as (select quote_id as pair, t.token_no,
  list_slice(embedding::double[], t.token_no * 8 + 1, t.token_no * 8 + 8) as attr
  from sense_items, lateral (select unnest(range(0, (len(embedding) + 7) // 8))::int as token_no) t)"""


def tokens(spark, sf):
    si = fx.sense_items(spark, sf)
    t = si.select(F.col("quote_id").alias("pair"), "embedding",
                  F.explode(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 8).cast("int") - 1))
                  .alias("token_no"))
    return t.select("pair", "token_no", F.slice(F.col("embedding").cast("array<double>"),
                                               F.col("token_no") * 8 + 1, F.lit(8)).alias("attr"))


@register("summarize_attributions", f"""{TOK},
s as (select pair, token_no, list_sum(attr) as s, list_dot_product(attr, attr) as q from tok),
n as (select pair, sqrt(sum(q)) as norm from s group by pair),
j as (select s.pair, token_no, s.s / n.norm as token_attr from s join n on s.pair = n.pair)
select j.pair, token_no, round(token_attr, 6) as token_attr, round(t.total, 6) as total from j
join (select pair, sum(token_attr) as total from j group by pair) t on t.pair = j.pair""")
def summarize_attributions(spark, sf):
    a = D.summarize_attributions(tokens(spark, sf))
    return a.select("pair", "token_no", r6("token_attr").alias("token_attr"), r6("total").alias("total"))


@register("attention_pool", f"""{TOK},
m as (select pair, attr, exp(attr[1] - max(attr[1]) over (partition by pair)) as e from tok where token_no <= 5),
w as (select pair, attr, e / sum(e) over (partition by pair) as w from m),
d as (select pair, i, sum(attr[i] * w) as v from w, range(1, 9) r(i) group by pair, i)
select pair, round(sum(v), 6) as pooled_sum, round(max(case when i = 1 then v end), 6) as pooled_first from d group by pair""")
def attention_pool(spark, sf):
    t = tokens(spark, sf).withColumn("logit", F.element_at("attr", 1)) \
        .withColumn("mask", F.col("token_no") <= 5)
    p = D.attention_pool(t, ["pair"], "attr", "logit", "mask")
    return p.select("pair", r6(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x)).alias("pooled_sum"),
                    r6(F.element_at("pooled", 1)).alias("pooled_first"))
