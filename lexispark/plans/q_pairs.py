"""Pair generation and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.functions.arrays import dot
from lexispark.functions.keys import r6
from lexispark.operators import lexicon as L
from lexispark.operators import pairs as J
from lexispark.plans.q_sampling import md5k
from lexispark.operators.scorers import order_scorer
from lexispark.operators.scorers import score_background as score_tiles
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx
from lexispark.sources.tables import table


def sint(seed: str, *cols: str) -> str:
    return f"('0x' || substr({md5k(seed, *cols)}, 1, 15))::bigint"


# --- word-in-context pairs --------------------------------------------------------------------

_WIC = f"""
b as (select quote_id, lemma, array_to_string(string_split(regexp_replace(numbering, '\\.+$', ''), '.')[1:1], '.')
  as sense from quotes),
ml as (select lemma from b group by lemma having min(sense) <> max(sense)),
r as (select b.*, row_number() over (partition by lemma, sense order by {md5k('wic-row', 'quote_id')}, quote_id) - 1
  as rn, count(*) over (partition by lemma, sense) as c from b where lemma in (select lemma from ml)),
sd as (select lemma, sense, c, row_number() over (partition by lemma order by {md5k('wic-sense', 'sense')}, sense) - 1
  as sn, count(*) over (partition by lemma) as s from (select distinct lemma, sense, c from r)),
base as (select r.quote_id, r.lemma, r.sense, r.rn, r.c, sd.sn, sd.s from r join sd on r.lemma = sd.lemma
  and r.sense = sd.sense where r.c >= 2),
pos as (select base.quote_id as q1, t.quote_id as q2, 1 as label, base.lemma from base join r t
  on t.lemma = base.lemma and t.sense = base.sense
  and t.rn = (base.rn + 1 + ({sint('wic-pos', 'base.quote_id')} % (base.c - 1))) % base.c),
neg as (select base.quote_id as q1, t.quote_id as q2, 0 as label, base.lemma from base
  join sd o on o.lemma = base.lemma and o.sn = (base.sn + 1 + {sint('wic-neg', 'base.quote_id')} % (base.s - 1)) % base.s
  join r t on t.lemma = o.lemma and t.sense = o.sense and t.rn = {sint('wic-negrow', 'base.quote_id')} % o.c),
wic as (select * from pos union all select * from neg)"""
WIC = f"{fx.duck_with('quotes')}, {_WIC.strip()}\n"


def wic_pairs(spark, sf):
    q = fx.quotes(spark, sf).withColumn("sense", X.depth_key("numbering", 1, "."))
    return J.sense_pairs(q, "lemma", "sense", "quote_id", nneg=1, npos=1)


@register("wic_pairs", f"{WIC}select q1, q2, cast(label as int) as label, lemma from wic")
def q_wic_pairs(spark, sf):
    return wic_pairs(spark, sf).select("q1", "q2", F.col("label").cast("int").alias("label"), "lemma")


@register("multi_sense_lemmas", f"""{fx.duck_with('quotes')}select lemma, count(*) as n from quotes
where lemma in (select lemma from quotes group by lemma having min(numbering) <> max(numbering)) group by lemma""")
def multi_sense_lemmas(spark, sf):
    q = J.multi_sense_lemmas(fx.quotes(spark, sf), "lemma", "numbering")
    return q.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


@register("pair_export", f"""{WIC}select q1, q2, cast(label as int) as label, wic.lemma, a.quote as quote_1,
  a.keyword as keyword_1, a.year as year_1, c.quote as quote_2, c.keyword as keyword_2, c.year as year_2
from wic join quotes a on a.quote_id = q1 join quotes c on c.quote_id = q2""")
def pair_export(spark, sf):
    p = wic_pairs(spark, sf).withColumn("label", F.col("label").cast("int"))
    return J.pair_export(p, fx.quotes(spark, sf))


@register("dedup_pairs_unique", f"""{WIC}select q1, q2, cast(label as int) as label, lemma from wic
where (least(q1, q2), greatest(q1, q2)) in (select (least(q1, q2), greatest(q1, q2)) from wic group by all
  having count(*) = 1)""")
def dedup_pairs_unique(spark, sf):
    p = wic_pairs(spark, sf).withColumn("label", F.col("label").cast("int"))
    return J.dedup_pairs(p, "unique")


@register("dedup_pairs_distinct", f"""{WIC}select q1, q2, cast(label as int) as label, lemma from (
  select *, row_number() over (partition by least(q1, q2), greatest(q1, q2) order by q1, q2, label) as k from wic)
where k = 1""")
def dedup_pairs_distinct(spark, sf):
    p = wic_pairs(spark, sf).withColumn("label", F.col("label").cast("int"))
    return J.dedup_pairs(p, "distinct")


# --- dated pairs ------------------------------------------------------------------------------------

DATED_SIZE = 5000
_DATED = f"""
src as (select quote_id, lemma from quotes where n_words >= 5 and year > 1450 and year < 1950),
dim as materialized (select lemma, count(*) as n, row_number() over (order by {md5k('dated', 'lemma')}, lemma) - 1 as li
  from src group by lemma),
nl as (select count(*) * (count(*) - 1) // 2 as m from dim),
dr as (select (({sint('dated-offset', "'pairs'")} % m + range::hugeint * ({J.STEP} % m)) % m)::bigint as p
  from range({DATED_SIZE}), nl where range < m),
all_lp as (select x.li as i, y.li as j, y.li * (y.li - 1) // 2 + x.li as p from dim x join dim y on x.li < y.li),
lp as materialized (select i, j from all_lp join dr using (p)),
rows as materialized (select quote_id, lemma, row_number() over (partition by lemma order by {md5k('dated-rows', 'quote_id')}, quote_id) - 1
  as rn from src),
sel as (select da.lemma as lemma_1, db.lemma as lemma_2, {sint('dated-ra', 'i', 'j')} % da.n as ra,
  {sint('dated-rb', 'i', 'j')} % db.n as rb from lp join dim da on da.li = i join dim db on db.li = j)"""


@register("dated_pairs", f"""{fx.duck_with('quotes')}, {_DATED.strip()}
select x.quote_id as q1, y.quote_id as q2, lemma_1, lemma_2 from sel
join rows x on x.lemma = lemma_1 and x.rn = ra join rows y on y.lemma = lemma_2 and y.rn = rb""")
def dated_pairs(spark, sf):
    q = L.filter_years(L.filter_words(fx.quotes(spark, sf), 5, strict=False))
    return J.dated_pairs(q, DATED_SIZE, "lemma", "quote_id")


@register("order_label", f"""{fx.duck_with('pairs')}select pair_id, y1, y2, (y1 > y2)::int as label from pairs""")
def order_label(spark, sf):
    return J.order_label(fx.pairs(spark, sf)).select("pair_id", "y1", "y2", "label")


# --- contrastive pairs on vectors ----------------------------------------------------------------------

_CON = f"""
r as (select quote_id, lemma, row_number() over (partition by lemma order by {md5k('contrast-row', 'quote_id')}, quote_id) - 1
  as rn from sense_items),
dim as (select lemma, count(*) as c, row_number() over (order by {md5k('contrast-label', 'lemma')}, lemma) - 1 as li
  from sense_items group by lemma),
nl as (select count(*) as l from dim),
base as (select r.*, dim.c, dim.li, nl.l from r join dim on r.lemma = dim.lemma, nl),
pos as (select base.quote_id as q1, t.quote_id as q2, 1 as y from base, range(1) tp(t) join r t
  on t.lemma = base.lemma and t.rn = {sint('contrast-pos', 'base.quote_id', 'tp.t')} % base.c),
negd as (select base.quote_id, tn.t, (base.li + 1 + {sint('contrast-lab', 'base.quote_id', 'tn.t')} % (base.l - 1)) % base.l as oli
  from base, range(2) tn(t) where base.l >= 2),
neg as (select negd.quote_id as q1, t.quote_id as q2, 0 as y from negd join dim o on o.li = negd.oli
  join r t on t.lemma = o.lemma and t.rn = {sint('contrast-neg', 'negd.quote_id', 'negd.t')} % o.c),
con as (select * from pos union all select * from neg)"""
CON = f"{fx.duck_with('sense_items')}, {_CON.strip()}\n"


def contrastive(spark, sf):
    return J.contrastive_pairs(fx.sense_items(spark, sf), "lemma", "quote_id", ratio=2, npos=1)


@register("contrastive_pairs", f"{CON}select q1, q2, cast(y as int) as y from con")
def contrastive_pairs(spark, sf):
    return contrastive(spark, sf).select("q1", "q2", F.col("y").cast("int").alias("y"))


@register("pair_vectors", f"""{CON}select q1, q2, cast(y as int) as y,
  round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot
from con join sense_items a on a.quote_id = q1 join sense_items b on b.quote_id = q2""")
def pair_vectors(spark, sf):
    p = J.with_vectors(contrastive(spark, sf), fx.sense_items(spark, sf), "quote_id", "embedding")
    return p.select("q1", "q2", F.col("y").cast("int").alias("y"), r6(dot("e1", "e2")).alias("dot"))


@register("complete_lemmas", f"""{fx.duck_with('quotes')}select lemma, count(*) as n_rows,
  count(e.vec_id) as n_with_vector, bool_and(e.vec_id is not null) as complete
from quotes left join embeddings e on e.vec_id = quotes.quote_id group by lemma""")
def complete_lemmas(spark, sf):
    q = fx.quotes(spark, sf)
    v = table(spark, sf, "embeddings", "vec_id").withColumnRenamed("vec_id", "quote_id")
    flagged = q.join(v.withColumn("_has", F.lit(True)), "quote_id", "left")
    ok = J.complete_lemmas(q, v, ["lemma"], id_col="quote_id").withColumn("complete", F.lit(True))
    agg = flagged.groupBy("lemma").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count("_has").alias("n_with_vector"))
    return agg.join(ok, "lemma", "left").select(
        "lemma", "n_rows", "n_with_vector", F.coalesce("complete", F.lit(False)).alias("complete"))


# --- products with bounded sides --------------------------------------------------------------------

@register("cross_with_background", f"""{fx.duck_with('scores')}select item_id, bg_id, item_year, bg_year,
  round(score, 6) as score from scores""")
def cross_with_background(spark, sf):
    s = fx.scores(spark, sf)
    return s.withColumn("score", r6("score"))


@register("cross_backward", f"""{fx.duck_with('scored_items', 'drawn_pool')}select i.item_id, g.bg_id,
  g.bg_id as s1_id, i.item_id as s2_id, 'backward' as direction from scored_items i, drawn_pool g""")
def cross_backward(spark, sf):
    x = J.cross_with_background(fx.scored_items(spark, sf), fx.drawn_pool(spark, sf), "backward")
    return x.select("item_id", "bg_id", "s1_id", "s2_id", "direction")


_HALF = "list_dot_product(x.embedding[1:32]::double[], y.embedding[33:64]::double[]) - " \
    "list_dot_product(x.embedding[33:64]::double[], y.embedding[1:32]::double[])"


@register("score_background", f"""{fx.duck_with('dating_items', 'background_pool')},
pr as (select item_id, bg_id, item_year, bg_year, x.embedding as e1, y.embedding as e2, {_HALF} as z
  from dating_items cross join background_pool join embeddings x on x.vec_id = item_id
  join embeddings y on y.vec_id = bg_id)
select item_id, bg_id, item_year, bg_year, 'forward' as direction, round(1 / (1 + exp(-8.0::double * z)), 6) as score from pr
union all select item_id, bg_id, item_year, bg_year, 'backward', round(1 / (1 + exp(8.0::double * z)), 6) from pr""")
def score_background(spark, sf):
    """Both directions of the item x background matrix from one pass of tiles, by a scorer on vectors."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    name = lambda c: e.select(F.col("vec_id").alias(c), "embedding")
    items = fx.dating_items(spark, sf).join(name("item_id"), "item_id")
    pool = fx.background_pool(spark, sf).join(name("bg_id"), "bg_id")
    s = score_tiles(items, pool.withColumnRenamed("embedding", "vector"), order_scorer("embedding", "vector"),
                    ["item_year", "embedding"], ["bg_year", "vector"])
    return s.select("item_id", "bg_id", "item_year", "bg_year", "direction", r6("score").alias("score"))


@register("span_product", f"""{fx.duck_with('sense_items')},
p as (select quote_id, year, cast(floor(year / 50) * 50 as int) as b, row_number() over (partition by floor(year / 50)
  order by {md5k('span', 'quote_id')}, quote_id) as r, least(200, count(*) over (partition by floor(year / 50))) as m
  from sense_items)
select x.quote_id as a_id, x.year as a_year, x.b as a_span, y.quote_id as b_id, y.year as b_year, y.b as b_span
from p x, p y where x.r <= x.m // 2 and y.r > y.m // 2 and y.r <= y.m""")
def span_product(spark, sf):
    return J.span_product(fx.sense_items(spark, sf), "year", 50, 200, "quote_id") \
        .select("a_id", "a_year", "a_span", "b_id", "b_year", "b_span")


@register("background_product", f"""{fx.duck_with('drawn_pool')},
p as (select bg_id, bg_year, row_number() over (partition by floor(bg_year / 50)
  order by {md5k('bgprod', 'bg_id')}, bg_id) as r from drawn_pool)
select x.bg_id as a_id, x.bg_year as a_year, y.bg_id as b_id, y.bg_year as b_year
from p x, p y where x.r <= 5 and y.r <= 5""")
def background_product(spark, sf):
    return J.background_product(fx.drawn_pool(spark, sf), "bg_year", 50, 5, "bg_id")


@register("common_vocab", f"""{fx.duck_with('tagged')},
v as (select distinct source as model, lower(unnest(tokens)) as token from tagged)
select token from v group by token having count(distinct model) = (select count(distinct model) from v)""")
def common_vocab(spark, sf):
    t = fx.tagged(spark, sf)
    v = t.select(F.col("source").alias("model"), F.explode("tokens").alias("token")) \
        .select("model", F.lower("token").alias("token")).distinct()
    return J.common_vocab(v, "token", "model")
