r"""Quality rules with adaptive thresholds (DataFrame functions only).

Every whole text is measured; each measure is binned on a logarithmic scale and the bin counts by
(lang, source) are its quantile sketch: relative error RELATIVE at most, and sketches merge by
adding counts.  The fences of a group come from the quartiles of its own sketch, or of the merged
sketch of its language, or of all groups, where fewer than ``least`` documents stand behind it.
A joined filter then rejects documents outside the fences.

Defined cases: a null text has no words and fails; null lang or source are groups of their own;
repeated rows count as often as they stand; clashing extra columns are replaced by the output's;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, let, settle, words_of

SYMBOLS = r"[#*$%&|<>]"
#: log-scale bins: value = LOWEST * GROWTH^bin; bin 0 holds all values up to LOWEST.
LOWEST, GROWTH = 0.001, 1.02
RELATIVE = GROWTH - 1
#: measure, side of the fence, slack: a fence is never nearer than ``slack`` to the quartile.
#: The slack keeps groups that hardly vary from losing ordinary documents.
RULES = (("symbol_ratio", 1, 0.30), ("dup_line_ratio", 1, 0.30), ("repeat_ratio", 1, 0.30),
         ("word_length", 1, 3.0), ("word_length", -1, 2.5))
FENCE = 3.0  # quartile distances beyond the quartile: Tukey's far-out fence
MEASURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length")
LOW24 = (1 << 24) - 1


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window whose words stand twice or more in the text.

    Windows are sorted as (40 hash bits, position) in one long each, so equal windows stand
    together; neighbours are compared word by word.  Where a neighbour has the same key and other
    words, which is rare, a window is compared with all of its key.  Texts of 2^24 words or more
    sort (hash, position) structs instead."""
    def same(w, a, b):
        return ((w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2]))

    def covered(at):  # sorted starts of repeated windows -> words in their union
        return F.when(F.size(at) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(
            at, F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(
                F.lit(3).cast("bigint"), p - acc["last"])).alias("n")),
            lambda acc: acc["n"]))

    def starts(w, s, hash_at, pos_at):
        def hit(j):
            met = lambda x: hash_at(s[j]) == hash_at(x)
            equal = lambda x: same(w, pos_at(s[j]).cast("int"), pos_at(x).cast("int"))
            before, after = s[F.greatest(j - 1, F.lit(0))], s[F.least(j + 1, F.size(s) - 1)]
            first, last = j > 0, j < F.size(s) - 1
            return (first & met(before) & equal(before)) | (last & met(after) & equal(after)) | (
                ((first & met(before)) | (last & met(after))) & F.exists(
                    s, lambda x: met(x) & (pos_at(x) != pos_at(s[j])) & equal(x)))
        return covered(F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), hit), lambda j: pos_at(s[j]))))

    def of(w):
        at = F.sequence(F.lit(0), F.size(w) - 3)
        small = F.sort_array(F.transform(at, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
                             .bitwiseAND(F.lit(~LOW24)).bitwiseOR(i.cast("bigint"))))
        large = F.sort_array(F.transform(at, lambda i: F.struct(
            F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.cast("bigint").alias("p"))))
        return (F.when(F.size(w) < 3, F.lit(0).cast("bigint"))
                .when(F.size(w) <= LOW24, let(small, lambda s: starts(
                    w, s, lambda x: F.shiftright(x, 24), lambda x: x.bitwiseAND(F.lit(LOW24)))))
                .otherwise(let(large, lambda s: starts(
                    w, s, lambda x: x["h"], lambda x: x["p"]))))
    return let(words, of)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(w):
        return F.struct(F.size(w).cast("bigint").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                        repeated_words(w).alias("n_repeat_words"))

    def line_counts(x):
        return F.struct(F.size(x).cast("bigint").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")
                        .alias("n_dup_lines"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, x = fresh("words"), fresh("lines")
    out = (df.drop(*[n for n in names if n != text])
           .withColumn(w, let(words_of(F.col(text)), counts))
           .withColumn(x, let(lines, line_counts)))
    return out.select("*", f"{w}.*", f"{x}.*", F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint")
                      .alias("n_symbols")).drop(w, x)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_ratio": F.col("n_symbols") / n,
            "dup_line_ratio": F.col("n_dup_lines")
            / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_ratio": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n}


def bin_of(value: Column) -> Column:
    return F.when(value <= LOWEST, 0).otherwise(
        F.ceil(F.log(value / LOWEST) / F.log(F.lit(GROWTH)))).cast("int")


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: one row a bin; adding n merges sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(v).alias("bin"))
                                for k, v in measures().items()]))
    return (metrics.filter("n_words > 0").select("lang", "source", pairs.alias("x"))
            .groupBy("lang", "source", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """q1, q3 and n_docs of each sketch: the values of the first bins whose running count reaches
    a quarter and three quarters."""
    merged = sketch.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "measure").orderBy("bin")
    ranked = merged.select(*group, "measure", "bin", F.sum("n").over(w).alias("upto"),
                           F.sum("n").over(Window.partitionBy(*group, "measure")).alias("all"))
    value = lambda b: F.when(b == 0, 0.0).otherwise(
        F.lit(LOWEST) * F.pow(F.lit(GROWTH), b.cast("double")))
    first = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    return (ranked.groupBy(*group, "measure")
            .agg(first(0.25).alias("b1"), first(0.75).alias("b3"), F.first("all").alias("n_docs"))
            .select(*group, "measure", value(F.col("b1")).alias("q1"),
                    value(F.col("b3")).alias("q3"), "n_docs"))


def thresholds(sketch: DataFrame, least: int = 100) -> DataFrame:
    """One row a (lang, source): a fence for each rule."""
    own = quartiles(sketch, "lang", "source")
    by_lang = quartiles(sketch, "lang").select(
        F.col("lang").alias("l2"), F.col("measure").alias("m2"), F.col("q1").alias("q1_2"),
        F.col("q3").alias("q3_2"), F.col("n_docs").alias("n_2"))
    overall = quartiles(sketch).select(F.col("measure").alias("m3"), F.col("q1").alias("q1_3"),
                                       F.col("q3").alias("q3_3"))
    chosen = (own.join(by_lang, F.col("lang").eqNullSafe(F.col("l2"))
                       & (F.col("measure") == F.col("m2")))
              .join(overall, F.col("measure") == F.col("m3")))
    pick = lambda q: F.when(F.col("n_docs") >= least, F.col(q)).when(
        F.col("n_2") >= least, F.col(f"{q}_2")).otherwise(F.col(f"{q}_3"))
    chosen = chosen.select("lang", "source", "measure", pick("q1").alias("q1"),
                           pick("q3").alias("q3"))
    fences = []
    for measure, side, slack in RULES:
        reach = F.greatest(F.lit(slack), F.lit(FENCE) * (F.col("q3") - F.col("q1")))
        fence = F.col("q3") + reach if side > 0 else F.col("q1") - reach
        fences.append(F.max(F.when(F.col("measure") == measure, fence))
                      .alias(f"{measure}_{'max' if side > 0 else 'min'}"))
    return chosen.groupBy("lang", "source").agg(*fences)


def judged(metrics: DataFrame, fences: DataFrame) -> DataFrame:
    """``metrics`` with base_failed and kept."""
    names = {c: fresh(c) for c in fences.columns}
    table = fences.select(*[F.col(c).alias(n) for c, n in names.items()])
    # a count of the rules that hold, not their conjunction: the optimiser would push a part of
    # that below the join and measure every text once more for it
    ok = (~base_failed()).cast("int")
    for measure, side, _ in RULES:
        value, name = measures()[measure], names[f"{measure}_{'max' if side > 0 else 'min'}"]
        ok = ok + F.coalesce(value <= F.col(name) if side > 0 else value >= F.col(name),
                             F.lit(True)).cast("int")
    joined = metrics.drop("base_failed", "kept").join(
        table, F.col("lang").eqNullSafe(F.col(names["lang"]))
        & F.col("source").eqNullSafe(F.col(names["source"])), "left")
    return (joined.withColumn("base_failed", base_failed()).withColumn("kept", ok == len(RULES) + 1)
            .drop(*table.columns))


def adaptive_quality(df: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept for every row of ``df``."""
    metrics = settle(measured(df.select("doc_id", "lang", "source", "text")).drop("text"),
                     "metrics")
    return judged(metrics, settle(thresholds(sketches(metrics), least), "fences"))


def keep_good(df: DataFrame, least: int = 100) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns.  Texts are measured once
    for the sketches and once for the filter, which costs less than moving them."""
    fences = settle(thresholds(sketches(measured(df.select("lang", "source", "text"))
                                        .drop("text")), least), "fences")
    packed = df.select("lang", "source", "text", F.struct("*").alias("__row"))
    return judged(measured(packed), fences).filter("kept").select("__row.*")


QUALITY_SQL = r"""
with texts as (
  select doc_id, lang, source, coalesce(text, '') as text from documents),
toks as (
  select doc_id, lang, source, text,
    [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] as w,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from texts),
grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from toks where len(w) >= 3)),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams)
  where n >= 2),
covered as (
  select doc_id, count(distinct p) as n
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
metrics as (
  select t.doc_id, lang, source, len(w)::bigint as n_words,
    length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words
  from toks t left join covered c using (doc_id)),
vals as (
  select doc_id, lang, source, n_words, unnest([
    {'m': 'symbol_ratio', 'v': n_symbols / greatest(n_words, 1)::double},
    {'m': 'dup_line_ratio', 'v': n_dup_lines / greatest(n_lines, 1)::double},
    {'m': 'repeat_ratio', 'v': n_repeat_words / greatest(n_words, 1)::double},
    {'m': 'word_length', 'v': word_chars / greatest(n_words, 1)::double}]) as x
  from metrics),
bins as (
  select lang, source, x.m as m,
    case when x.v <= 0.001 then 0 else ceil(ln(x.v / 0.001) / ln(1.02))::int end as b, count(*) as n
  from vals where n_words > 0 group by all),
levels as (
  select 1 as lv, lang as g1, source as g2, m, b, n from bins
  union all select 2, lang, null, m, b, sum(n) from bins group by lang, m, b
  union all select 3, null, null, m, b, sum(n) from bins group by m, b),
ranked as (
  select *, sum(n) over (partition by lv, g1, g2, m order by b) as upto,
    sum(n) over (partition by lv, g1, g2, m) as total from levels),
quart as (
  select lv, g1, g2, m, any_value(total) as total,
    min(case when upto >= 0.25 * total then b end) as b1,
    min(case when upto >= 0.75 * total then b end) as b3 from ranked group by lv, g1, g2, m),
vq as (
  select lv, g1, g2, m, total, case when b1 = 0 then 0.0 else 0.001 * pow(1.02, b1) end as q1,
    case when b3 = 0 then 0.0 else 0.001 * pow(1.02, b3) end as q3 from quart),
chosen as (
  select a.g1 as lang, a.g2 as source, a.m,
    case when a.total >= 100 then a.q1 when b.total >= 100 then b.q1 else c.q1 end as q1,
    case when a.total >= 100 then a.q3 when b.total >= 100 then b.q3 else c.q3 end as q3
  from vq a join vq b on b.lv = 2 and a.g1 is not distinct from b.g1 and a.m = b.m
    join vq c on c.lv = 3 and a.m = c.m where a.lv = 1),
fences as (
  select lang, source,
    max(case when m = 'symbol_ratio' then q3 + greatest(0.30, 3 * (q3 - q1)) end) as s_max,
    max(case when m = 'dup_line_ratio' then q3 + greatest(0.30, 3 * (q3 - q1)) end) as d_max,
    max(case when m = 'repeat_ratio' then q3 + greatest(0.30, 3 * (q3 - q1)) end) as r_max,
    max(case when m = 'word_length' then q3 + greatest(3.0, 3 * (q3 - q1)) end) as l_max,
    max(case when m = 'word_length' then q1 - greatest(2.5, 3 * (q3 - q1)) end) as l_min
  from chosen group by lang, source),
judged as (
  select k.*, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
    coalesce(n_symbols / greatest(n_words, 1)::double <= s_max, true)
    and coalesce(n_dup_lines / greatest(n_lines, 1)::double <= d_max, true)
    and coalesce(n_repeat_words / greatest(n_words, 1)::double <= r_max, true)
    and coalesce(word_chars / greatest(n_words, 1)::double <= l_max, true)
    and coalesce(word_chars / greatest(n_words, 1)::double >= l_min, true) as inside
  from metrics k left join fences f
    on k.lang is not distinct from f.lang and k.source is not distinct from f.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and inside) as kept
from judged
"""
