"""Split and sampling queries (P1-P17) on the quotes stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import sampling as S
from lexispark.plans.registry import register
from lexispark.sources import fixtures as fx

Q = fx.duck_with("quotes")
TEST_FILES = ["src3", "src7", "src12"]


def md5k(seed: str, *cols: str) -> str:
    """DuckDB form of the seeded key."""
    parts = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"md5(concat_ws(':', '{seed}', {parts}))"


def unit(seed: str, *cols: str) -> str:
    return f"(('0x' || substr({md5k(seed, *cols)}, 1, 15))::bigint / 1152921504606846976.0::double)"


SENSES = f"""{Q}, sq as (select quote_id, lemma, year,
  array_to_string(string_split(regexp_replace(numbering, '\\.+$', ''), '.')[1:2], '.') as sense from quotes)"""


def senses(spark, sf):
    return fx.quotes(spark, sf).select("quote_id", "lemma", "year",
                                       X.depth_key("numbering", 2, ".").alias("sense"))


@register("split_by_fraction", f"""{Q}select quote_id, case when {unit('split', 'quote_id')} < 0.9 then 'train'
  when {unit('split', 'quote_id')} < 0.95 then 'test' else 'dev' end as role from quotes""")
def split_by_fraction(spark, sf):
    q = fx.quotes(spark, sf)
    return S.split_by_fraction(q, "quote_id", (0.9, 0.05, 0.05)).select("quote_id", "role")


_EXACT = f"""r as (select quote_id, row_number() over (order by {md5k('split', 'quote_id')}, quote_id) as rn,
  count(*) over () as n from quotes),
e as (select quote_id, case when rn <= floor(n * 0.9) then 'train' when rn <= floor(n * 0.95) then 'test'
  else 'dev' end as role from r)"""


@register("split_exact", f"{Q}, {_EXACT} select quote_id, role from e")
def split_exact(spark, sf):
    q = fx.quotes(spark, sf)
    return S.split_by_fraction(q, "quote_id", (0.9, 0.05, 0.05), exact=True).select("quote_id", "role")


@register("split_background", f"""{Q}, {_EXACT},
t as (select quote_id, row_number() over (order by {md5k('bg', 'quote_id')}, quote_id) as rn,
  count(*) over () as n from e where role = 'train')
select quote_id, case when rn <= floor(n * 0.75) then 'train' else 'background' end as role from t""")
def split_background(spark, sf):
    q = fx.quotes(spark, sf)
    tr = S.split_by_fraction(q, "quote_id", (0.9, 0.05, 0.05), exact=True).where("role = 'train'")
    return S.split_by_fraction(tr.drop("role"), "quote_id", (0.75, 0.25), ("train", "background"),
                               seed="bg", exact=True).select("quote_id", "role")


@register("sample_per_decade", f"""{Q}select quote_id, decade from (
  select quote_id, cast(floor(year / 10) * 10 as int) as decade, row_number() over (
    partition by floor(year / 10) order by {md5k('sample', 'quote_id')}, quote_id) as rn from quotes)
where rn <= 20""")
def sample_per_decade(spark, sf):
    q = fx.quotes(spark, sf).withColumn("decade", X.year_bin("year", 10))
    return S.sample_per_group(q, "decade", 20, id_col="quote_id").select("quote_id", "decade")


@register("sample_up_to", f"""{Q}select quote_id, lemma from (
  select quote_id, lemma, row_number() over (partition by lemma order by {md5k('cap', 'quote_id')}, quote_id) as rn
  from quotes) where rn <= 50""")
def sample_up_to(spark, sf):
    q = fx.quotes(spark, sf)
    return S.sample_up_to(q, "lemma", 50, seed="cap", id_col="quote_id").select("quote_id", "lemma")


@register("split_by_key", f"""{Q}select quote_id, lemma, {md5k('heldout', 'lemma')} < '19999999' as heldout
from quotes""")
def split_by_key(spark, sf):
    q = fx.quotes(spark, sf)
    return S.split_by_key(q, "lemma", 0.1).select("quote_id", "lemma", "heldout")


@register("sample_keys", f"""{Q}select lemma from (select distinct lemma from quotes)
order by {md5k('keys', 'lemma')}, lemma limit 5""")
def sample_keys(spark, sf):
    return S.sample_keys(fx.quotes(spark, sf), "lemma", 5)


@register("select_dev", f"""{Q}, {_EXACT},
z as (select lemma from (select distinct lemma from quotes) order by {md5k('keys', 'lemma')}, lemma limit 5),
qe as (select quotes.quote_id, lemma, role from quotes join e on quotes.quote_id = e.quote_id)
select quote_id, lemma from qe where role = 'test'
  and lemma in (select lemma from qe where role = 'train') and lemma not in (select lemma from z)""")
def select_dev(spark, sf):
    q = fx.quotes(spark, sf).select("quote_id", "lemma")
    e = S.split_by_fraction(q, "quote_id", (0.9, 0.05, 0.05), exact=True)
    zero = S.sample_keys(q, "lemma", 5)
    return S.select_dev(e.where("role = 'test'"), e.where("role = 'train'"), zero).select("quote_id", "lemma")


_ELIG = """el as (select * from sq where (lemma, sense) in (
    select (lemma, sense) from (select lemma, sense from sq group by lemma, sense having count(*) >= 2)
    where lemma in (select lemma from (select lemma, sense, count(*) as c from sq group by lemma, sense having count(*) >= 2)
                    group by lemma having sum(c) >= 2 and count(*) > 1)))"""


@register("eligible_senses", f"{SENSES}, {_ELIG} select quote_id, lemma, sense from el")
def eligible_senses(spark, sf):
    return S.eligible_senses(senses(spark, sf), "lemma", "sense").select("quote_id", "lemma", "sense")


_STRAT = f"""st as (select quote_id, lemma, sense, case when row_number() over (partition by lemma, sense
    order by {md5k('strat', 'quote_id')}, quote_id) <= least(count(*) over (partition by lemma, sense) - 1,
    greatest(1, ceil(count(*) over (partition by lemma, sense) * 0.5))) then 'train' else 'test' end as role from el)"""


@register("stratified_split", f"{SENSES}, {_ELIG}, {_STRAT} select quote_id, lemma, sense, role from st")
def stratified_split(spark, sf):
    el = S.eligible_senses(senses(spark, sf), "lemma", "sense")
    return S.stratified_split(el, ["lemma", "sense"], 0.5, id_col="quote_id") \
        .select("quote_id", "lemma", "sense", "role")


def _wsd_sql(d: int) -> str:
    return f"""select {d} as depth, quote_id, lemma, sense, zero, case when row_number() over (
      partition by lemma, sense order by {md5k(f'wsd-{d}', 'quote_id')}, quote_id) <= least(
      count(*) over (partition by lemma, sense) - 1, greatest(1, ceil(count(*) over (partition by lemma, sense) * 0.5)))
      then 'train' else 'test' end as role from (
      select quote_id, lemma, sense, {md5k('wsd-zero', 'lemma')} < '19999999' as zero from (
        select *, array_to_string(string_split(regexp_replace(numbering, '\\.+$', ''), '.')[1:{d}], '.') as sense
        from quotes) k
      where (lemma, sense) in (select (lemma, sense) from (
          select lemma, sense, count(*) as c, sum(count(*)) over (partition by lemma) as tot,
            count(*) over (partition by lemma) as ns
          from (select lemma, array_to_string(string_split(regexp_replace(numbering, '\\.+$', ''), '.')[1:{d}], '.') as sense
                from quotes) group by lemma, sense having count(*) >= 2) x
        where x.lemma in (select lemma from (select lemma, sense from (select lemma,
            array_to_string(string_split(regexp_replace(numbering, '\\.+$', ''), '.')[1:{d}], '.') as sense from quotes)
            group by lemma, sense having count(*) >= 2) group by lemma having count(*) > 1)))"""


@register("wsd_splits", f"{Q}{_wsd_sql(1)} union all {_wsd_sql(2)}")
def wsd_splits(spark, sf):
    q = fx.quotes(spark, sf)
    out = S.wsd_splits(q, [1, 2], id_col="quote_id")
    return out.select(F.col("depth").cast("int").alias("depth"), "quote_id", "lemma", "sense", "zero", "role")


@register("fewshot_draws", f"""{SENSES}, {_ELIG}, {_STRAT},
tr as materialized (select * from st where role = 'train'),
it as (select range::int as iteration from range(20)),
rk as materialized (select iteration, quote_id, row_number() over (partition by iteration, lemma, sense
  order by {md5k('fewshot', 'iteration', 'quote_id')}, quote_id) as rn from tr, it),
sz as (select unnest([1, 2, 5, 10, 15, 25]) as n)
select cast(n as varchar) as n_items, iteration, quote_id from rk join sz on rn <= n
union all select 'full' as n_items, 0 as iteration, quote_id from tr""")
def fewshot_draws(spark, sf):
    el = S.eligible_senses(senses(spark, sf), "lemma", "sense")
    tr = S.stratified_split(el, ["lemma", "sense"], 0.5, id_col="quote_id").where("role = 'train'")
    d = S.fewshot_draws(tr.drop("role"), ["lemma", "sense"], 20, id_col="quote_id")
    return d.select("n_items", "iteration", "quote_id")


@register("split_files", f"""{fx.duck_with('tagged')},
f as (select distinct source from tagged),
r as (select source, case when source in ({", ".join(f"'{t}'" for t in TEST_FILES)}) then 'test'
  when {md5k('files', 'source')} < '0ccccccc' then 'dev' else 'train' end as role from f),
k as (select *, row_number() over (partition by role order by {md5k('files', 'source')}, source) as rk from r),
sz as (select * from (values (5, '5'), (10, '10'), (null, 'full')) t(n, size))
select source, role, size from k join sz on role <> 'train' or n is null or rk <= n""")
def split_files(spark, sf):
    t = fx.tagged(spark, sf)
    return S.split_files(t, "source", TEST_FILES, 0.05, (5, 10, None))


@register("first_n", f"{Q}select quote_id, lemma from quotes order by quote_id limit 100")
def first_n(spark, sf):
    return S.first_n(fx.quotes(spark, sf), 100, "quote_id").select("quote_id", "lemma")


@register("weighted_sample", f"""{SENSES},
w as (select *, 1.0::double / count(*) over (partition by lemma, sense) as weight from sq)
select quote_id, lemma from (select quote_id, lemma, row_number() over (partition by lemma order by
  -ln(greatest({unit('weighted', 'quote_id')}, 1e-12)) / weight, quote_id) as rn from w) where rn <= 10""")
def weighted_sample(spark, sf):
    w = S.sense_weight(senses(spark, sf), ["lemma", "sense"], "uniform")
    return S.weighted_sample(w, "lemma", "weight", 10, id_col="quote_id").select("quote_id", "lemma")


@register("lemma_halves", f"""{SENSES},
k as (select * from sq where (lemma, sense) in (select (lemma, sense) from sq group by lemma, sense having count(*) >= 2))
select quote_id, lemma, sense, case when row_number() over (partition by lemma, sense order by
  {md5k('halves', 'quote_id')}, quote_id) <= least(count(*) over (partition by lemma, sense) - 1,
  greatest(1, ceil(count(*) over (partition by lemma, sense) * 0.5))) then 'support' else 'query' end as role from k""")
def lemma_halves(spark, sf):
    return S.lemma_halves(senses(spark, sf), id_col="quote_id").select("quote_id", "lemma", "sense", "role")


@register("assign_batches", f"""{Q}select quote_id, cast((row_number() over (order by {md5k('batches', 'quote_id')},
  quote_id) - 1) // 248 as bigint) as batch from quotes""")
def assign_batches(spark, sf):
    return S.assign_batches(fx.quotes(spark, sf), 248, id_col="quote_id").select("quote_id", "batch")


def sint(seed: str, *cols: str) -> str:
    return f"('0x' || substr({md5k(seed, *cols)}, 1, 15))::bigint"


def episodes_sql(src: str, n_episodes: int, strategy: str, max_support: int, max_query: int,
                 attempts: int = 10, seed: str = "episodes") -> str:
    """The episodes of ``sample_episodes`` over a relation with lemma, sense and quote_id: CTEs that end in
    ep (episode, attempt, role, lemma, sense, quote_id), by the same draws on windows over all rows."""
    primes = ", ".join(map(str, S.PRIMES))
    if strategy == "uniform":
        pick = f"""ch as (select d.episode, d.attempt, l.lemma from dw d join (select lemma, row_number() over (
    order by {md5k(seed + '-lemma', 'lemma')}, lemma) as li, count(*) over () as k from (select distinct lemma from sc)) l
  on d.u % l.k + 1 = l.li)"""
    else:
        pick = f"""ch as (select d.episode, d.attempt, l.lemma from dw d join (select lemma, row_number() over (
    order by {md5k(seed + '-row', 'quote_id')}, quote_id) as ri, count(*) over () as k from rk) l on d.u % l.k + 1 = l.ri)"""

    def rows(role: str, first: str, last: str) -> str:
        return f"""{role}p as (select episode, attempt, lemma, sense, ((o + t.p * a) % c)::bigint as r0
  from sa, lateral (select unnest(range({first}, {last}))::hugeint as p) t)"""

    def capped(role: str, src: str, cap: int) -> str:
        return f"""{role} as (select episode, attempt, lemma, sense, quote_id from (select x.*, row_number() over (
    partition by episode, attempt order by {md5k(seed + '-cap', 'episode', 'attempt', 'quote_id')}, quote_id) as cp
  from ({src}) x) where cp <= {cap})"""
    return f"""sc as materialized (select lemma, sense, count(*) as c from {src} group by lemma, sense having count(*) >= 2),
rk as materialized (select s.lemma, s.sense, quote_id, row_number() over (partition by s.lemma, s.sense
  order by {md5k(seed, 'quote_id')}, quote_id) - 1 as r0 from {src} s join sc on sc.lemma = s.lemma and sc.sense = s.sense),
dw as (select e.range as episode, a.range::int as attempt, {sint(seed, 'e.range', 'a.range')} as u
  from range({n_episodes}) e, range({attempts}) a),
{pick},
sb as (select ch.*, sc.sense, sc.c, [{primes}][({sint(seed + '-prime', 'episode', 'attempt', 'sc.sense')} % {len(S.PRIMES)})::int + 1] as a0,
  {sint(seed, 'episode', 'attempt', 'sc.sense')} % sc.c as o, least(sc.c - 1, greatest(1, ceil(sc.c * 0.5)::bigint)) as cut
  from ch join sc on sc.lemma = ch.lemma),
sa as materialized (select *, (case when a0 % c = 0 then {S.LAST_PRIME} else a0 end)::hugeint as a from sb),
{rows('sup', '0', f'least(cut, {max_support})')}, {rows('qry', 'cut', f'least(c, cut + {max_query})')},
{capped('su', 'select p.episode, p.attempt, p.lemma, p.sense, rk.quote_id from supp p join rk on rk.lemma = p.lemma and rk.sense = p.sense and rk.r0 = p.r0', max_support)},
hv as materialized (select distinct episode, attempt, sense from su),
{capped('qu', 'select p.episode, p.attempt, p.lemma, p.sense, rk.quote_id from qryp p join hv on hv.episode = p.episode and hv.attempt = p.attempt and hv.sense = p.sense join rk on rk.lemma = p.lemma and rk.sense = p.sense and rk.r0 = p.r0', max_query)},
fi as (select episode, min(attempt) as attempt from qu group by episode),
ep as (select 'support' as role, su.* from su join fi on fi.episode = su.episode and fi.attempt = su.attempt
  union all select 'query', qu.* from qu join fi on fi.episode = qu.episode and fi.attempt = qu.attempt)"""


@register("sample_episodes", f"""{SENSES}, {episodes_sql('sq', 200, 'frequency', 40, 40)}
select episode, role, lemma, sense, quote_id from ep""")
def sample_episodes(spark, sf):
    out = S.sample_episodes(senses(spark, sf), 200, id_col="quote_id", strategy="frequency",
                            max_support=40, max_query=40)
    return out.select("episode", "role", "lemma", "sense", "quote_id")
