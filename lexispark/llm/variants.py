r"""Spelling variant grouping by permuterm rotations.

A word is marked with a terminator and rotated to every place: ``w[r:] $ w[:r]``.  A rotation
without its last character is what all words share that differ in that character only, and it is
itself a whole rotation of the word that lacks it.  So in sorted rotations, words that are near each
other (one code point inserted, deleted or replaced) stand in one range: the whole rotation
``b$a`` of ``ab`` and all ``b$ac`` of ``acb``, whatever c is.  A range has one row for each
character that can stand at the edited place, and one for none, so at most the alphabet (about
90); it is scanned once, and each row is told how many others there are and which is the most
frequent.  No pairs are made.  A character inserted into a run of itself is found in one range for
each place of the run, and counted in the first alone.

Words are counted task by task before they are shuffled.  Forms are followed to their roots by
doubling the links; as a form has at least ``ratio`` times the occurrences of its word, chains are
short.

Defined cases: null and empty texts have no words; a null doc_id reads as an empty one; each of
repeated rows counts; ties between forms go to the smallest word in code-point order; other columns
are ignored; a text of any length is read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import settle

#: Letters of words, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
END = "$"                   # stands in no word
HELD = 200_000              # distinct words a task counts before it hands them on


def with_lost_letter(doc_id, run: str, every: int) -> str:
    """The run, or what is left of it where its document has one letter dropped."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, min_length: int = 6, min_n: int = 5, every: int = 199) -> DataFrame:
    """word, n of the words of ``docs`` (doc_id, text) that are long and frequent enough."""
    def run(batches):
        find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall
        held: Counter[str] = Counter()

        def rows():
            got = pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
            held.clear()
            return got
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer()
                if raw is None:
                    continue
                # bytes.lower() changes A-Z only
                for word, n in Counter(find(raw.to_pybytes().lower().decode())).items():
                    word = with_lost_letter(doc_id, word, every)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()
    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n))


def rotations(words: DataFrame) -> DataFrame:
    """range, edit, word, n: every rotation, whole (edit empty) and without its last character."""
    r, w = F.col("r"), F.col("word")
    turned = F.concat(F.substring(w, r + 1, F.length(w)), F.lit(END), F.substring(w, F.lit(1), r))
    both = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("r")) \
        .select("word", "n", F.explode(F.array(
            F.struct(turned.alias("range"), F.lit("").alias("edit")),
            # rotated to 0 the last character is the terminator, which is no edit
            F.when(r > 0, F.struct(F.substring(turned, F.lit(1), F.length(w)).alias("range"),
                                   F.substring(w, r, F.lit(1)).alias("edit"))))).alias("x"))
    return both.where("x is not null").select("x.range", "x.edit", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best and best_n: how many words are near, and the most frequent of them."""
    share = Window.partitionBy("range").orderBy(F.desc("n"), "word").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)      # at most the alphabet and one
    whole = F.col("edit") == ""
    # a character equal to the one before it is counted where that one is dropped
    first = F.col("edit") != F.substring("range", -1, 1)
    top = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    scanned = rotations(words).select(
        "word", "n", "edit", "range",
        F.sum(F.when(~whole, 1).otherwise(0)).over(share).alias("edited"),
        F.sum(F.when(~whole & first, 1).otherwise(0)).over(share).alias("inserted"),
        F.max(whole).over(share).alias("has_whole"),
        F.first(top).over(share).alias("one"), F.nth_value(top, 2).over(share).alias("two")) \
        .where("two is not null")
    told = scanned.select(
        "word", "n",
        F.when(whole, F.col("inserted")).otherwise(
            F.col("edited") - 1 + F.when(F.col("has_whole") & first, 1).otherwise(0)).alias("near"),
        F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("top"))
    none = F.lit(None).cast("struct<n:bigint,word:string>")
    return told.unionByName(words.select("word", "n", F.lit(0).alias("near"), none.alias("top"))) \
        .groupBy("word", "n").agg(F.sum("near").cast("bigint").alias("n_near"),
                                  F.min("top").alias("top")) \
        .select("word", "n", "n_near", F.col("top.word").alias("best"), (-F.col("top.n")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root for links (word, form): every turn doubles the links that are followed."""
    hop = settle(links.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hop = settle(hop.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "links")
        if not hop.where("moved").limit(1).count():
            return hop.select("word", "root")
        hop = hop.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 6, min_n: int = 5, ratio: int = 5,
                      every: int = 199) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word; form: the near word of which it seems to
    be a variant."""
    words = settle(word_counts(docs, min_length, min_n, every), "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = settle(near_words(words).select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: The same by SQL: crc32 byte by byte, and words that share what is left without one character.
VARIANTS_SQL = r"""
with recursive shift(i, k, v) as (
    select i, 0, i from range(256) t(i)
    union all select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end
    from shift where k < 8),
crc as materialized (select list(v order by i) as t from shift where k = 8),
runs as (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-zÀ-ÿ]+')) as run
        from documents)
    where length(run) >= 6 group by doc_id, run),
codes as (
    select run, n, list_concat([4294967295], flatten(list_transform(
        string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
        lambda c: case when unicode(c) < 128 then [unicode(c)::bigint]
                       else [195::bigint, unicode(c)::bigint - 64] end))) as codes
    from runs),
hashed as (
    select run, n, xor(list_reduce(codes, lambda a, b: xor(a // 256, t[1 + xor(a & 255, b)])),
                       4294967295) as h
    from codes, crc),
words as materialized (
    select word, sum(n)::bigint as n from (
        select case when h % 199 = 0
                    then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
                    else run end as word, n from hashed)
    where length(word) >= 6 group by word having sum(n) >= 5),
holes as materialized (
    select word, n, i, left(word, i::int - 1) as a, substr(word, i::int + 1) as b
    from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
    select x.word, y.word as other, y.n as other_n
    from holes x join holes y on x.a = y.a and x.b = y.b and x.word != y.word
    union
    select x.word, y.word, y.n from holes x join words y on x.a || x.b = y.word
    union
    select y.word, x.word, x.n from holes x join words y on x.a || x.b = y.word),
best as (
    select word, count(*) as n_near, arg_min(other, (-other_n, other)) as best, max(other_n) as best_n
    from near group by word),
formed as materialized (
    select w.word, w.n, coalesce(n_near, 0) as n_near,
           case when best_n >= 5 * w.n then best end as form,
           case when best_n >= 5 * w.n then best_n end as form_n
    from words w left join best using (word)),
chain(word, root, steps) as (
    select word, word, 0 from formed
    union all
    select c.word, f.form, c.steps + 1 from chain c join formed f on f.word = c.root
    where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n,
       (select arg_max(c.root, c.steps) from chain c where c.word = f.word) as root
from formed f
"""
