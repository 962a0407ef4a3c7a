"""Tagging, sub-word and masked-word queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.keys import r6, rkey
from lexispark.operators import tagging as T
from lexispark.operators.sampling import hex_threshold
from lexispark.plans.q_sampling import md5k
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx

TG = fx.duck_with("tagged")
TRAIN_CUT = hex_threshold(0.8)
SPLIT = f"""tr as (select * from tagged where {md5k('tagsplit', 'sent_id')} < '{TRAIN_CUT}'),
te as (select * from tagged where {md5k('tagsplit', 'sent_id')} >= '{TRAIN_CUT}'),
li as (select tag, row_number() over (order by tag) - 1 as label_id from (select distinct unnest(tags) as tag from tr))"""


def split(spark, sf):
    t = fx.tagged(spark, sf)
    k = rkey("tagsplit", "sent_id")
    return t.where(k < F.lit(TRAIN_CUT)), t.where(k >= F.lit(TRAIN_CUT))


@register("tag_label_index", f"{TG}, {SPLIT} select tag, label_id from li")
def tag_label_index(spark, sf):
    tr, _ = split(spark, sf)
    return T.label_index(tr).select("tag", F.col("label_id").cast("bigint"))


@register("tag_align_labels", f"""{TG}, {SPLIT},
w as (select t.sent_id, u.w, u.t, u.p, greatest(ceil(length(u.w) / 4), 1)::int as c from te t,
  unnest(list_zip(t.tokens, t.tags, t.preds)) x(z), lateral (select z[1] as w, z[2] as t, z[3] as p) u),
j as (select w.*, coalesce(a.label_id, -101) as la, coalesce(b.label_id, -101) as lp from w
  left join li a on a.tag = w.t left join li b on b.tag = w.p)
select te.sent_id, cast(2 + coalesce(sum(c), 0) as bigint) as n_sub, cast(2 + coalesce(sum(c - 1), 0) as bigint) as n_ignored,
  cast(coalesce(sum(la), 0) - 100 * (2 + coalesce(sum(c - 1), 0)) as bigint) as sum_ids,
  cast(count(j.sent_id) as bigint) as n_kept, cast(coalesce(sum((la = lp)::int), 0) as bigint) as n_match,
  cast(least(len(te.tokens), 512) as int) as n_trunc
from te left join j on j.sent_id = te.sent_id group by te.sent_id, te.tokens""")
def tag_align_labels(spark, sf):
    tr, te = split(spark, sf)
    lm = T.label_map(T.label_index(tr))
    d = te.crossJoin(F.broadcast(lm)).withColumn("wids", T.word_ids("tokens"))
    d = d.withColumn("al", T.align_labels("wids", "tags", "label_map")) \
        .withColumn("ap", T.align_labels("wids", "preds", "label_map"))
    kept = T.strip_ignored("al", "ap")
    return d.select("sent_id", F.size("al").cast("bigint").alias("n_sub"),
                    F.size(F.filter("al", lambda x: x == T.IGNORE)).cast("bigint").alias("n_ignored"),
                    F.aggregate("al", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ids"),
                    F.size(kept).cast("bigint").alias("n_kept"),
                    F.size(F.filter(kept, lambda x: x["l"] == x["p"])).cast("bigint").alias("n_match"),
                    F.size(T.truncate_tokens("tokens", 512)).alias("n_trunc"))


_TM = """e as (select unnest(tags) as t, unnest(preds) as p from tagged),
g as (select t as tag, count(*) as n_true, sum((t = p)::int) as tp from e group by t),
pp as (select p as tag, count(*) as n_pred from e group by p),
j as (select coalesce(g.tag, pp.tag) as tag, coalesce(tp, 0) as tp, coalesce(n_true, 0) as n_true,
  coalesce(n_pred, 0) as n_pred from g full join pp on g.tag = pp.tag),
m as (select tag, case when n_pred > 0 then tp / n_pred else 0 end as precision,
  case when n_true > 0 then tp / n_true else 0 end as recall, n_true as support from j)"""


@register("tag_token_metrics", f"""{TG}, {_TM}
select tag, round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1,
  cast(support as bigint) as support from m""")
def tag_token_metrics(spark, sf):
    per, _ = T.token_metrics(fx.tagged(spark, sf))
    return per.select("tag", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), F.col("support").cast("bigint"))


#: The stand-in's tags read as BIO tags (I-X may stand behind anything, so some chunks start with it).
BIO = {"T0": "O", "T1": "B-X", "T2": "I-X", "T3": "B-Y", "T4": "I-Y"}


def bio(spark, sf):
    t = fx.tagged(spark, sf)
    names = F.create_map(*[F.lit(x) for kv in BIO.items() for x in kv])
    read = lambda c: F.transform(c, lambda x: F.element_at(names, x)).alias(c)
    return t.select("sent_id", read("tags"), read("preds"))


_BIO_CASE = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in BIO.items()) + " end"


def _chunk_sql(col: str) -> str:
    """Chunks of the tag lists by numbering the places where one starts."""
    return f"""(select sent_id, min(i) as a, max(i) as z, any_value(ty) as tag from (
  select sent_id, i, ty, sum(fresh) over (partition by sent_id order by i) as c from (
    select sent_id, i, ty, (ty is not null and (t like 'B-%' or ty is distinct from
      lag(ty) over (partition by sent_id order by i)))::int as fresh from (
      select sent_id, i, t, case when t like 'B-%' or t like 'I-%' then substr(t, 3) end as ty from (
        select sent_id, i, {_BIO_CASE} as t from (
          select sent_id, unnest({col}) as t, generate_subscripts({col}, 1) as i from tagged)))))
  where ty is not null group by sent_id, c)"""


@register("tag_entity_metrics", f"""{TG}, g as {_chunk_sql('tags')}, p as {_chunk_sql('preds')},
c as (select coalesce(g.tag, p.tag) as tag, count(g.a) as n_true, count(p.a) as n_pred,
    count(case when g.a is not null and p.a is not null then 1 end) as tp
  from g full join p on g.sent_id = p.sent_id and g.a = p.a and g.z = p.z and g.tag = p.tag group by 1),
al as (select * from c union all select 'overall', sum(n_true), sum(n_pred), sum(tp) from c),
m as (select tag, n_true, case when n_pred > 0 then tp / n_pred else 0 end as p,
  case when n_true > 0 then tp / n_true else 0 end as r from al)
select tag, round(p, 6) as precision, round(r, 6) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, cast(n_true as bigint) as support from m""")
def tag_entity_metrics(spark, sf):
    per, overall = T.entity_metrics(bio(spark, sf))
    both = per.unionByName(overall.withColumn("tag", F.lit("overall")))
    return both.select("tag", r6("precision").alias("precision"), r6("recall").alias("recall"),
                       r6("f1").alias("f1"), F.col("support").cast("bigint"))


@register("tag_accuracy", f"""{TG} select round(avg((t = p)::int::double), 6) as accuracy from (
  select unnest(tags) as t, unnest(preds) as p from tagged)""")
def tag_accuracy(spark, sf):
    _, acc = T.token_metrics(fx.tagged(spark, sf))
    return acc.select(r6("accuracy").alias("accuracy"))


@register("tag_flatten_metrics", f"""{TG}, {_TM}
select tag, metric, round(value, 6) as value from (
  select tag, 'precision' as metric, precision as value from m union all select tag, 'recall', recall from m
  union all select tag, 'f1', case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end from m)""")
def tag_flatten_metrics(spark, sf):
    per, _ = T.token_metrics(fx.tagged(spark, sf))
    return T.flatten_metrics(per).select("tag", "metric", r6("value").alias("value"))


@register("tag_sentence_scores", f"""{TG}, {SPLIT}
select sent_id, len(tokens) as n_tokens, len(list_filter(tags, lambda t: list_contains(known, t))) as n_labels,
  len(list_filter(list_zip(tags, preds), lambda z: z[1] = z[2])) as n_true from te, (select list(tag) as known from li)""")
def tag_sentence_scores(spark, sf):
    tr, te = split(spark, sf)
    known = T.label_index(tr).agg(F.collect_list("tag").alias("known"))
    d = te.crossJoin(F.broadcast(known))
    return d.select("sent_id", *T.sentence_scores("tokens", "tags", "preds", "known"))


@register("tag_vocabulary", f"{TG}, {SPLIT} select distinct unnest(tokens) as token from tr")
def tag_vocabulary(spark, sf):
    tr, _ = split(spark, sf)
    return T.vocabulary(tr)


_OOV = f"""{TG}, {SPLIT}, voc as (select distinct unnest(tokens) as token from tr),
e0 as (select sent_id, unnest(tokens) as token, unnest(tags) as tag, unnest(preds) as pred from te),
e as (select * from e0 where tag in (select tag from li where tag <> 'T4')),
c as (select sent_id, tag, token in (select token from voc) as known, count(*) as total,
  sum((tag = pred)::int) as correct from e group by all)"""


def known_labels(tr):
    """A label index that lacks a tag of the test sentences, whose tokens are to be skipped."""
    return T.label_index(tr).where("tag <> 'T4'")


@register("tag_oov_maps", f"""{_OOV} select sent_id,
  coalesce(list_sum([x.total for x in l if x.known]), 0)::bigint as known_total,
  coalesce(list_sum([x.total for x in l if not x.known]), 0)::bigint as unknown_total,
  coalesce(list_sum([x.correct for x in l if x.known]), 0)::bigint as known,
  coalesce(list_sum([x.correct for x in l if not x.known]), 0)::bigint as unknown,
  len([x for x in l if x.known])::int as n_known_tags
from (select sent_id, list({{'known': known, 'total': total, 'correct': correct}}) as l from c group by sent_id)""")
def tag_oov_maps(spark, sf):
    tr, te = split(spark, sf)
    m = T.oov_maps(T.oov_counts(te, T.vocabulary(tr), "sent_id", known_labels(tr)), "sent_id")
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return m.select("sent_id", *[total(c).alias(c) for c in ("known_total", "unknown_total", "known", "unknown")],
                    F.size("known_total").alias("n_known_tags"))


@register("tag_oov_counts", f"{_OOV} select sent_id, tag, known, total, cast(correct as bigint) as correct from c")
def tag_oov_counts(spark, sf):
    tr, te = split(spark, sf)
    c = T.oov_counts(te, T.vocabulary(tr), "sent_id", known_labels(tr))
    return c.select("sent_id", "tag", "known", "total", F.col("correct").cast("bigint"))


@register("tag_oov_report", f"""{_OOV} select tag, known, cast(sum(total) as bigint) as total,
  cast(sum(correct) as bigint) as correct, round(sum(correct) / sum(total), 6) as accuracy from c
group by rollup (tag, known)""")
def tag_oov_report(spark, sf):
    tr, te = split(spark, sf)
    r = T.oov_report(te, T.vocabulary(tr), known_labels(tr))
    return r.select("tag", "known", F.col("total").cast("bigint"), F.col("correct").cast("bigint"),
                    r6("accuracy").alias("accuracy"))


@register("tag_alignment_violations", f"""{TG}, {SPLIT}
select sent_id from tagged, (select list(tag) as known from li) where sent_id % 7 = 0 and preds <> tags
  and 2 + list_sum([greatest(ceil(length(x) / 4), 1) for x in tokens]) < 512
  and list_has_all(known, list_concat(tags, preds))""")
def tag_alignment_violations(spark, sf):
    """Every seventh sentence carries the labels of its predictions: these differ from its tags."""
    tr, _ = split(spark, sf)
    lm = T.label_map(T.label_index(tr))
    wrong = F.when(F.col("sent_id") % 7 == 0, F.col("preds")).otherwise(F.col("tags"))
    d = fx.tagged(spark, sf).crossJoin(F.broadcast(lm)).withColumn("wids", T.word_ids("tokens")) \
        .withColumn("given", wrong).withColumn("al", T.align_labels("wids", "given", "label_map"))
    return T.alignment_violations(d, "sent_id", "al", "wids", "tags", "label_map")


@register("tag_argmax", f"""{TG} select sent_id, len(tokens) as n_tokens,
  len(list_filter(tags, lambda t: t = 'T0')) as n_match from tagged""")
def tag_argmax(spark, sf):
    t = fx.tagged(spark, sf)
    labels = F.array(*[F.lit(f"T{i}") for i in range(5)])
    scores = F.transform("tokens", lambda x: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(
        k == (2 * F.length(x)) % 5, F.lit(1.0)).otherwise(k * 0.1)))
    pred = T.argmax_label(scores, labels)
    z = F.arrays_zip(F.col("tags").alias("t"), pred.alias("p"))
    return t.select("sent_id", F.size("tokens").alias("n_tokens"),
                    F.size(F.filter(z, lambda x: x["t"] == x["p"])).alias("n_match"))


@register("tag_metric_record", f"""{TG}, {SPLIT} select (select count(*) from tr) as train_samples,
  least((select count(*) from te), 100) as eval_samples, (select count(*) from te) as predict_samples""")
def tag_metric_record(spark, sf):
    tr, te = split(spark, sf)
    return T.metric_record(tr, te, te, caps=(None, 100, None))


_PIECES = """w as (select sent_id, u.i as word_no, u.w as word, greatest(ceil(length(u.w) / 4), 1)::int as c
  from tagged, unnest(list_zip(tokens, range(0, len(tokens)))) x(z), lateral (select z[1] as w, z[2] as i) u),
s as (select *, 1 + coalesce(sum(c) over (partition by sent_id order by word_no rows between unbounded preceding
  and 1 preceding), 0) as st from w)"""


@register("tag_group_subwords", f"""{TG}, {_PIECES}
select sent_id, cast(word_no as int) as word_no, word, array_to_string(range(st::bigint, (st + c)::bigint), ',') as idx from s""")
def tag_group_subwords(spark, sf):
    t = fx.tagged(spark, sf)
    p = t.select("sent_id", F.concat(F.array(F.lit("[CLS]")), T.subword_pieces("tokens"),
                                     F.array(F.lit("[SEP]"))).alias("pieces"))
    g = T.group_subwords(p, "sent_id", "pieces")
    return g.select("sent_id", F.col("word_no").cast("int"), "word", F.array_join("idx", ",").alias("idx"))


@register("tag_pool_word_vector", f"""{TG}, {_PIECES},
k as (select sent_id, min(word_no) as kw_no from s where length(word) >= 8 group by sent_id),
f as (select s.sent_id, min(s.word_no) as word_no from s join k on k.sent_id = s.sent_id
  join s s2 on s2.sent_id = k.sent_id and s2.word_no = k.kw_no where lower(s.word) = lower(s2.word) group by s.sent_id)
select s.sent_id, round(length(s.word) / s.c, 6) as v_len, round(s.st + (s.c - 1) / 2, 6) as v_pos,
  cast(s.c as bigint) as n_subtokens from s join f on f.sent_id = s.sent_id and f.word_no = s.word_no""")
def tag_pool_word_vector(spark, sf):
    t = fx.tagged(spark, sf)
    long = F.filter("tokens", lambda w: F.length(w) >= 8)
    pieces = F.concat(F.array(F.lit("[CLS]")), T.subword_pieces("tokens"), F.array(F.lit("[SEP]")))
    p = t.select("sent_id", pieces.alias("pieces"), F.get(long, 0).alias("keyword"))
    # only the keyword's own words leave the row
    g = T.group_subwords(p, "sent_id", "pieces", only="keyword")
    # exploded where they are built: conditions on a named column would be computed before the rows are dealt, too
    tv = t.select("sent_id", F.posexplode(pieces).alias("pos", "piece")).select(
        "sent_id", "pos", F.array(F.length(F.regexp_replace("piece", "^##", "")).cast("double"),
                                  F.col("pos").cast("double")).alias("vec"))
    kw = t.select("sent_id", F.explode(F.slice(long, 1, 1)).alias("keyword"))
    v = T.pool_word_vector(g, tv, kw, "sent_id")
    return v.select("sent_id", r6(F.element_at("vector", 1)).alias("v_len"),
                    r6(F.element_at("vector", 2)).alias("v_pos"), F.col("n_subtokens").cast("bigint"))


# --- masked words --------------------------------------------------------------------------------

CA = fx.duck_with("candidates")
_RANK = """rk as (select quote_id, kw, coalesce(list_position(list_transform(candidates, lambda x: x.token_str), kw), -1) as rank,
  candidates from candidates)"""


@register("mask_keyword_rank", f"""{CA}, {_RANK} select quote_id, cast(rank as int) as rank,
  case when rank > 0 then round(candidates[rank].score, 6) end as score from rk""")
def mask_keyword_rank(spark, sf):
    c = fx.candidates(spark, sf)
    rank, score = T.keyword_rank("candidates", "kw")
    return c.select("quote_id", rank, r6(score).alias("score"))


@register("mask_rank_report", f"""{CA}, {_RANK} select round(avg(case when rank > 0 then 1.0 / rank else 0 end), 6) as mrr,
  round(avg((rank > 0 and rank <= 1)::int::double), 6) as hit_at_1, round(avg((rank > 0 and rank <= 5)::int::double), 6)
  as hit_at_5, round(avg((rank < 0)::int::double), 6) as unranked from rk""")
def mask_rank_report(spark, sf):
    c = fx.candidates(spark, sf)
    rank, _ = T.keyword_rank("candidates", "kw")
    r = T.rank_report(c.select(rank))
    return r.select(*[r6(x).alias(x) for x in ("mrr", "hit_at_1", "hit_at_5", "unranked")])


@register("mask_vocab_report", f"""{TG},
v as (select distinct source as model, lower(unnest(tokens)) as token from tagged),
cm as (select token from v group by token having count(distinct model) = (select count(distinct model) from v))
select model, count(*) as vocab, (select count(*) from cm) as common from v group by model""")
def mask_vocab_report(spark, sf):
    from lexispark.operators.pairs import common_vocab
    t = fx.tagged(spark, sf)
    v = t.select(F.col("source").alias("model"), F.explode("tokens").alias("token")) \
        .select("model", F.lower("token").alias("token")).distinct()
    common = common_vocab(v).agg(F.count(F.lit(1)).alias("common"))
    return v.groupBy("model").agg(F.count(F.lit(1)).alias("vocab")).crossJoin(F.broadcast(common))


@register("mask_vocab_sizes", f"""{fx.duck_with('tagged', 'quotes')},
v as (select distinct lower(unnest(tokens)) as token from tagged),
k as (select distinct keyword from quotes)
select count(*) as n_before, count(v.token) as n_after,
  (select count(*) from quotes where keyword in (select token from v)) as n_rows
from k left join v on v.token = k.keyword""")
def mask_vocab_sizes(spark, sf):
    from lexispark.operators import lexicon as L
    q = fx.quotes(spark, sf)
    v = fx.tagged(spark, sf).select(F.explode("tokens").alias("token")).select(F.lower("token").alias("token"))
    return L.vocabulary_sizes(q, v).crossJoin(L.in_vocab(q, v).agg(F.count(F.lit(1)).alias("n_rows")))


_WORDS = ("small", "red", "ring", "gear", "blue", "cat")


@register("mask_scores", f"""{fx.duck_with('quotes')},
m as (select quote_id, keyword, case when strpos(quote, keyword) > 0 then substr(quote, 1, strpos(quote, keyword) - 1)
  else quote end as before from quotes),
b as (select quote_id, keyword, length(list_last([x for x in string_split(before, ' ') if x <> ''])) as n from m),
r as (select quote_id, w.w, row_number() over (partition by quote_id order by abs(length(w.w) - n), w.w) as rank
  from b, (select unnest({list(_WORDS)}) as w) w)
select b.quote_id, 'length' as model, b.keyword, coalesce(r.rank, -1)::int as rank, round(1.0::double / (r.rank + 1), 6) as score
from b left join r on r.quote_id = b.quote_id and r.w = b.keyword""")
def mask_scores(spark, sf):
    from lexispark.operators import scorers as P
    m = P.score_masks(fx.quotes(spark, sf), {"length": P.length_scorer(_WORDS)})
    return m.select("quote_id", "model", "keyword", "rank", r6("score").alias("score"))


@register("pair_scores", f"""{fx.duck_with('pairs')},
c as (select pair_id, list_distinct(string_split(s1, '')) as a, list_distinct(string_split(s2, '')) as b from pairs),
s as (select pair_id, len(list_intersect(a, b)) as n, len(a) as na, len(b) as nb from c)
select pair_id, 'overlap' as model, 'forward' as direction, round(n / na, 6) as score from s
union all select pair_id, 'overlap', 'backward', round(n / nb, 6) from s""")
def pair_scores(spark, sf):
    from lexispark.operators import scorers as P
    p = fx.pairs(spark, sf)
    both = P.score_pairs(p, {"overlap": P.overlap_scorer}).unionByName(
        P.score_pairs(p, {"overlap": P.overlap_scorer}, backward=True))
    return both.select("pair_id", "model", "direction", r6("score").alias("score"))


@register("mask_fill_bigram", f"""{fx.duck_with('tagged', 'quotes')},
e as (select sent_id, i, lower(tokens[i]) as w from tagged, range(1, len(tokens) + 1) r(i)),
bg as (select a.w as prev, b.w as word, count(*) as n from e a join e b on a.sent_id = b.sent_id and b.i = a.i + 1
  group by all),
tp as (select prev, word, n / sum(n) over (partition by prev) as score,
  row_number() over (partition by prev order by n desc, word) as rank from bg),
q as (select quote_id, lower(keyword) as kw, lower(list_last(string_split(trim(substr(quote, 1, strpos(quote, keyword) - 1)), ' ')))
  as prev from quotes where strpos(quote, keyword) > 0),
m as (select q.quote_id, q.kw, tp.word, tp.rank, tp.score from q join tp on tp.prev = q.prev and tp.rank <= 5)
select q.quote_id, coalesce(max(case when m.word = q.kw then m.rank end), -1) as rank,
  round(max(case when m.word = q.kw then m.score end), 6) as score, cast(count(m.word) as bigint) as n_candidates
from q left join m on m.quote_id = q.quote_id group by q.quote_id""")
def mask_fill_bigram(spark, sf):
    model = T.bigram_model(fx.tagged(spark, sf), k=5)
    q = fx.quotes(spark, sf).where(F.instr("quote", F.col("keyword")) > 0)
    before = F.expr("substring(quote, 1, instr(quote, keyword) - 1)")
    q = q.select("quote_id", F.lower("keyword").alias("kw"),
                 F.lower(F.element_at(F.split(F.trim(before), " "), -1)).alias("prev"))
    cands = T.fill_mask(q, model, "quote_id")
    j = q.join(cands, "quote_id", "left")
    rank, score = T.keyword_rank("candidates", "kw")
    return j.select("quote_id", F.coalesce(rank, F.lit(-1)).alias("rank"), r6(score).alias("score"),
                    F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("n_candidates"))
