"""Lexicon queries (L1-L15) on the quotes stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import lexicon as L
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx

Q = fx.duck_with("quotes")

# DuckDB forms, written from the definitions (not from the Spark plan).
_P2 = ("regexp_replace(replace(replace(replace(string_split(word, ',')[2], 'and', ''), '(', ''), ')', ''),"
       " '^\\s+|\\s+$', '', 'g')")
D_POS = (f"case when len(string_split(word, ',')) >= 2 then split_part(case when contains({_P2}, ' ') "
         f"then regexp_extract({_P2}, '^\\S+', 0) else {_P2} end, '.', 1) end")
D_PARTS = "string_split(regexp_replace(numbering, '\\.+$', ''), '.')"
D_DEPTH = f"len({D_PARTS})"

W2 = f"""
w2 as (select *, {D_POS} as pos from quotes where not contains(word, '†')),
w2p as (select * from w2 where pos in ('n', 'adj', 'v')),
w2c as (select lemma from w2p group by lemma having count(*) > 100 and lemma not in ('the', 'much')),
w2f as (select * from w2p where lemma in (select lemma from w2c))"""

W3 = f"""
w3 as (select * from quotes where n_words > 5),
w3c as (select lemma from w3 group by lemma having count(*) >= 100),
w3f as (select *, {D_POS} as pos from w3 where lemma in (select lemma from w3c)),
w3p as (select * from w3f where pos in ('n', 'adj', 'v'))"""


@register("lex_drop_obsolete", f"{Q}select quote_id, lemma, word from quotes where not contains(word, '†')")
def lex_drop_obsolete(spark, sf):
    return L.drop_obsolete(fx.quotes(spark, sf)).select("quote_id", "lemma", "word")


@register("lex_first_pos", f"{Q}select quote_id, {D_POS} as pos from quotes")
def lex_first_pos(spark, sf):
    return L.with_pos(fx.quotes(spark, sf)).select("quote_id", "pos")


@register("lex_filter_pos", f"{Q}select quote_id, lemma, pos from (select *, {D_POS} as pos from quotes) "
          "where pos in ('n', 'adj', 'v')")
def lex_filter_pos(spark, sf):
    return L.filter_pos(L.with_pos(fx.quotes(spark, sf))).select("quote_id", "lemma", "pos")


@register("lex_value_counts", f"{Q}select {D_POS} as pos, count(*) as count from quotes group by 1")
def lex_value_counts(spark, sf):
    return L.value_counts(L.with_pos(fx.quotes(spark, sf)), "pos")


@register("lex_sense_depth", f"{Q}select quote_id, numbering, cast({D_DEPTH} as int) as sense_depth from quotes")
def lex_sense_depth(spark, sf):
    return L.with_depth(fx.quotes(spark, sf)).select("quote_id", "numbering", "sense_depth")


@register("lex_depth_keys", f"""{Q}, d as (select distinct {D_DEPTH} as depth from quotes)
select quote_id, cast(d.depth as int) as depth, array_to_string({D_PARTS}[1:d.depth], '-') as key
from quotes cross join d""")
def lex_depth_keys(spark, sf):
    return L.depth_keys_long(fx.quotes(spark, sf), "quote_id", joiner="-")


@register("lex_frequent", f"""{Q}, {W2.strip()}
select lemma, count(*) as n from w2f group by lemma""")
def lex_frequent(spark, sf):
    q = L.filter_pos(L.with_pos(L.drop_obsolete(fx.quotes(spark, sf))))
    f = L.frequent(q, "lemma", 100, strict=True, exclude=X.STOP_LEMMAS)
    return f.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


@register("lex_filter_words", f"{Q}select quote_id, n_words from quotes where n_words > 5")
def lex_filter_words(spark, sf):
    return L.filter_words(fx.quotes(spark, sf), 5, strict=True).select("quote_id", "n_words")


@register("lex_filter_years", f"{Q}select quote_id, year from quotes where year > 1450 and year < 1950")
def lex_filter_years(spark, sf):
    return L.filter_years(fx.quotes(spark, sf)).select("quote_id", "year")


@register("lex_year_bin", f"""{Q}select quote_id, year, cast(floor(year / 10) * 10 as int) as bin10,
  cast(floor(year / 25) * 25 as int) as bin25, cast(floor(year / 50) * 50 as int) as bin50 from quotes""")
def lex_year_bin(spark, sf):
    q = fx.quotes(spark, sf)
    return q.select("quote_id", "year", *[X.year_bin("year", s).alias(f"bin{s}") for s in (10, 25, 50)])


@register("lex_qualify_sense", f"""{Q}select quote_id,
  concat(lemma, '+', array_to_string({D_PARTS}[1:1], '.')) as qualified from quotes""")
def lex_qualify_sense(spark, sf):
    q = fx.quotes(spark, sf)
    return q.select("quote_id", X.qualify("lemma", X.depth_key("numbering", 1, ".")).alias("qualified"))


@register("lex_has_keyword", f"{Q}select quote_id, keyword from quotes where contains(quote, keyword)")
def lex_has_keyword(spark, sf):
    return L.has_keyword(fx.quotes(spark, sf)).select("quote_id", "keyword")


#: The quote cut once into runs of word characters and single others; the keyword (one word here) is the
#: first piece that equals it, and what stands before it gives the offset.
_KW_SPAN = """pc as (select quote_id, quote, keyword,
  regexp_extract_all(quote, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]') as t from quotes),
sp as (select quote_id, quote, length(array_to_string(t[1:list_position(t, keyword) - 1], '')) as st, length(keyword) as n
  from pc where list_position(t, keyword) > 0)"""


@register("lex_find_keyword", f"""{Q}, {_KW_SPAN}
select quote_id, cast(st as int) as start, cast(st + n as int) as "end" from sp""")
def lex_find_keyword(spark, sf):
    return L.find_keyword(fx.quotes(spark, sf)).select("quote_id", "start", "end")


@register("lex_prepare_retrieval", f"""{Q}, {W2.strip()}
select quote_id, lemma, quote, keyword, year, n_words, numbering, pos, cast({D_DEPTH} as int) as sense_depth from w2f""")
def lex_prepare_retrieval(spark, sf):
    out = L.prepare_lexicon(fx.quotes(spark, sf), "retrieval", min_count=100)
    return L.select_columns(out, ["pos", "sense_depth"])


@register("lex_retrieval_table", f"""{Q}, {W2.strip()},
p as (select *, string_split(regexp_replace(numbering, '\\.+$', ''), '.') as parts from w2f)
select lemma, numbering as senseId, quote, keyword, year, n_words as nWords,
  array_to_string(parts[1:1], '-') as "depth-1", array_to_string(parts[1:2], '-') as "depth-2",
  array_to_string(parts[1:3], '-') as "depth-3" from p""")
def lex_retrieval_table(spark, sf):
    return L.retrieval_table(fx.quotes(spark, sf), (1, 2, 3), sense_id="numbering")


@register("text_subtoken_span", f"""{Q}, {_KW_SPAN}, s as (select quote_id, quote, st, st + n as en from sp)
select quote_id, (st // 3)::int as "first", ceil(en / 3)::int as "last" from s
where st % 3 = 0 and (en % 3 = 0 or en = length(quote))""")
def text_subtoken_span(spark, sf):
    """Sub-tokens of three characters each; keywords that are not made of whole ones are left out."""
    q = L.find_keyword(fx.quotes(spark, sf))
    n = F.length("quote")
    offsets = F.transform(F.sequence(F.lit(0), F.ceil(n / 3).cast("int") - 1), lambda i: F.struct(
        (3 * i).alias("start"), F.least(3 * i + 3, n).alias("end")))
    span = F.explode_outer(F.array(X.subtoken_span(offsets, "start", "end")))
    return q.select("quote_id", span.alias("_s")).where("_s is not null").select("quote_id", "_s.first", "_s.last")


@register("lex_prepare_pairs", f"""{Q}, {W3.strip()}
select quote_id, lemma, quote, keyword, year, n_words, numbering, pos, cast({D_DEPTH} as int) as sense_depth from w3p""")
def lex_prepare_pairs(spark, sf):
    out = L.prepare_lexicon(fx.quotes(spark, sf), "pairs", min_count=100, min_words=5)
    return L.select_columns(out, ["pos", "sense_depth"])


@register("text_mask_first", f"""{Q}select quote_id,
  case when strpos(quote, keyword) > 0 then substr(quote, 1, strpos(quote, keyword) - 1) || '[MASK]' ||
    substr(quote, strpos(quote, keyword) + length(keyword)) else quote end as masked from quotes""")
def text_mask_first(spark, sf):
    return fx.quotes(spark, sf).select("quote_id", X.mask_first("quote", "keyword").alias("masked"))


@register("text_mark_keyword", f"""{Q}select quote_id,
  case when strpos(quote, keyword) > 0 then substr(quote, 1, strpos(quote, keyword) - 1) || '[TGT] ' || keyword
    || ' [TGT]' || substr(quote, strpos(quote, keyword) + length(keyword)) end as marked,
  strpos(quote, keyword) = 0 as missing from quotes""")
def text_mark_keyword(spark, sf):
    q = fx.quotes(spark, sf)
    return q.select("quote_id", X.mark_keyword("quote", "keyword").alias("marked"),
                    (F.instr("quote", F.col("keyword")) == 0).alias("missing"))


@register("text_mark_span", f"""{Q}, {_KW_SPAN}, s as (select quote_id, quote, st, st + n as en from sp)
select quote_id, substr(quote, 1, st) || '[TGT] ' || substr(quote, st + 1, en - st) || ' [TGT]' || substr(quote, en + 1)
  as marked, cast(st + 6 as int) as new_start, cast(en + 6 as int) as new_end from s""")
def text_mark_span(spark, sf):
    q = L.find_keyword(fx.quotes(spark, sf))
    shift = len(X.TARGET_MARK) + 1
    return q.select("quote_id", X.mark_span("quote", "start", "end").alias("marked"),
                    (F.col("start") + shift).cast("int").alias("new_start"),
                    (F.col("end") + shift).cast("int").alias("new_end"))
