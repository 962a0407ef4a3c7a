"""Lexicon preparation (L1-L15): filters and projections over quotation tables.

Everything is a narrow transformation except the lemma frequency filter, which is one
partial/final aggregate on the lemma plus a left-semi join (the aggregate result is one
row per lemma; Spark broadcasts it when small, AQE decides at run time).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import (KEEP_POS, STOP_LEMMAS, depth_key, first_pos,
                                      keyword_span, sense_depth, year_bin)


def drop_obsolete(df: DataFrame, word: str = "word", mark: str = "†") -> DataFrame:
    return df.where(~F.col(word).contains(mark))


def with_pos(df: DataFrame, word: str = "word", out: str = "pos") -> DataFrame:
    return df.withColumn(out, first_pos(word))


def filter_pos(df: DataFrame, keep: Sequence[str] = tuple(KEEP_POS), pos: str = "pos"):
    return df.where(F.col(pos).isin(list(keep)))


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Counts per value, ordered by count desc then value (deterministic ties)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.col(col))


def frequent(df: DataFrame, key: str = "lemma", min_count: int = 100, strict: bool = True,
             exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose key occurs more than (strict) / at least min_count times, minus excluded."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.where(F.col("_n") > min_count if strict else F.col("_n") >= min_count)
    if exclude:
        keep = keep.where(~F.col(key).isin(list(exclude)))
    return df.join(keep.select(key), key, "left_semi")


def filter_words(df: DataFrame, n: int, strict: bool = True, col: str = "n_words"):
    return df.where(F.col(col) > n if strict else F.col(col) >= n)


def filter_years(df: DataFrame, lo: int = 1450, hi: int = 1950, col: str = "year"):
    """Open interval lo < year < hi."""
    return df.where((F.col(col) > lo) & (F.col(col) < hi))


def with_year_bin(df: DataFrame, span: int, col: str = "year", out: str = "bin"):
    return df.withColumn(out, year_bin(col, span))


def with_depth(df: DataFrame, numbering: str = "numbering", out: str = "sense_depth"):
    return df.withColumn(out, sense_depth(numbering))


def depth_keys_long(df: DataFrame, id_col: str, numbering: str = "numbering",
                    joiner: str = "-") -> DataFrame:
    """(id, depth, key) for every depth that occurs anywhere in the table.

    The depth dimension is a distinct over a small integer column, joined back by
    broadcast: no driver round trip, no dynamic schema.
    """
    depths = df.select(sense_depth(numbering).alias("depth")).distinct()
    return df.select(id_col, numbering).crossJoin(F.broadcast(depths)).select(
        id_col, "depth", depth_key(numbering, F.col("depth"), joiner).alias("key"))


def add_depth_keys(df: DataFrame, depths: Sequence[int], numbering: str = "numbering",
                   joiner: str = "-", prefix: str = "depth_") -> DataFrame:
    """Wide form: one column per given depth."""
    for d in depths:
        df = df.withColumn(f"{prefix}{d}", depth_key(numbering, d, joiner))
    return df


def has_keyword(df: DataFrame, quote: str = "quote", keyword: str = "keyword"):
    return df.where(F.col(quote).contains(F.col(keyword)))


def find_keyword(df: DataFrame, quote: str = "quote", keyword: str = "keyword"):
    """Add start/end char offsets of the keyword's first whole-token occurrence; rows
    without one are dropped."""
    # a generator, as the optimiser would paste a named column into the filter and all its uses
    return df.withColumn("_span", F.explode_outer(F.array(keyword_span(quote, keyword)))).where("_span is not null") \
        .withColumn("start", F.col("_span.start")).withColumn("end", F.col("_span.end")) \
        .drop("_span")


SELECTED = ["quote_id", "lemma", "quote", "keyword", "year", "n_words", "numbering"]


def select_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*SELECTED, *extra)


def prepare_lexicon(df: DataFrame, recipe: str = "retrieval", min_count: int = 100,
                    min_words: int = 5) -> DataFrame:
    """The two lexicon recipes.

    'retrieval': drop obsolete -> first POS in (n, adj, v) -> lemmas with > min_count rows
    (counted after the POS filter) minus stop lemmas.
    'pairs': n_words > min_words -> lemmas with >= min_count rows (counted before the POS
    filter) -> POS filter.
    """
    if recipe == "retrieval":
        out = filter_pos(with_pos(drop_obsolete(df)))
        out = frequent(out, "lemma", min_count, strict=True, exclude=STOP_LEMMAS)
    elif recipe == "pairs":
        out = frequent(filter_words(df, min_words, strict=True), "lemma", min_count, strict=False)
        out = filter_pos(with_pos(out))
    else:
        raise ValueError(recipe)
    return with_depth(out)


def retrieval_table(df: DataFrame, depths: Sequence[int] = (1, 2, 3), sense_id: str = "senseId",
                    n_words: str = "n_words", min_count: int = 100) -> DataFrame:
    """The retrieval recipe with its output columns: lemma, senseId, quote, keyword, year, nWords and
    one sense key per depth (depth-1 ... depth-N, parts joined by '-')."""
    out = add_depth_keys(prepare_lexicon(df, "retrieval", min_count), depths, joiner="-", prefix="depth-")
    return out.select("lemma", F.col(sense_id).alias("senseId"), "quote", "keyword", "year",
                      F.col(n_words).alias("nWords"), *[f"`depth-{d}`" for d in depths])


def in_vocab(df: DataFrame, vocab: DataFrame, keyword: str = "keyword", token: str = "token") -> DataFrame:
    """Rows whose keyword is in the vocabulary."""
    return df.join(vocab.select(F.col(token).alias(keyword)).distinct(), keyword, "left_semi")


def vocabulary_sizes(df: DataFrame, vocab: DataFrame, keyword: str = "keyword",
                     token: str = "token") -> DataFrame:
    """One row: distinct keywords before and after the restriction to the vocabulary."""
    words = df.select(F.col(keyword).alias("_k")).where("_k is not null").distinct()
    kept = vocab.select(F.col(token).alias("_k")).distinct().withColumn("_in", F.lit(1))
    return words.join(kept, "_k", "left").agg(F.count(F.lit(1)).alias("n_before"),
                                              F.count("_in").alias("n_after"))


__all__ = ["drop_obsolete", "with_pos", "filter_pos", "value_counts", "frequent", "filter_words",
           "filter_years", "with_year_bin", "with_depth", "depth_keys_long", "add_depth_keys",
           "has_keyword", "find_keyword", "retrieval_table", "in_vocab", "vocabulary_sizes",
            "select_columns", "prepare_lexicon", "year_bin"]
