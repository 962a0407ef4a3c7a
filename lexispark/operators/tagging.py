"""Sequence tagging and masked-word evaluation.

Per-sentence work stays inside the row (higher-order array functions); corpus-level
counts explode tokens and aggregate.  Tokens are counted before they meet a vocabulary, so a
hot word is a few rows at the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.arrays import let
from lexispark.operators.sampling import _list, join_dim

IGNORE, UNSEEN = -100, -101  # fixed label sentinels
SUBWORD_PREFIX = "##"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- T1 labels --------------------------------------------------------------------------------

def label_index(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Sorted distinct labels -> 0-based ids (a small dimension, windowed after distinct)."""
    d = df.select(F.explode(tags).alias("tag")).distinct()
    return d.select("tag", (F.row_number().over(Window.orderBy("tag")) - 1).alias("label_id"))


def label_map(index: DataFrame) -> DataFrame:
    """One-row table holding the label -> id map (bounded by the number of labels)."""
    return index.agg(F.map_from_entries(F.collect_list(F.struct("tag", "label_id"))).alias("label_map"))


# --- sub-word stand-in tokenizer and V1 -------------------------------------------------------------

MARK = "\u0001"     # stands between words while a sentence is cut in one pass


def subword_pieces(tokens, width: int = 4) -> Column:
    """Split each word into pieces of ``width`` chars, continuation pieces prefixed '##'.

    The sentence is cut as one text by one regular expression; word by word where a word is null or holds the
    mark that stands between words."""
    def one_by_one(words):
        return F.flatten(F.transform(words, lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.length(w) / width).cast("int") - 1, F.lit(0))),
            lambda i: F.concat(F.when(i > 0, F.lit(SUBWORD_PREFIX)).otherwise(F.lit("")),
                               F.substring(w, i * width + 1, width)))))

    def cut(x):
        # as many marks as there are words, if none is null or holds one itself
        plain = ~F.exists(x["words"], lambda w: w.isNull()) & (F.length(x["text"]) - F.length(F.replace(x["text"], F.lit(MARK), F.lit(""))) == F.size(x["words"]) - 1)
        pieces = F.regexp_replace(x["text"], f"([^{MARK}]{{{width}}})(?=[^{MARK}])", f"$1{MARK}{SUBWORD_PREFIX}")
        return F.when(plain, F.split(pieces, MARK, -1)).otherwise(one_by_one(x["words"]))
    return let(_c(tokens), lambda words: let(F.struct(words.alias("words"), F.array_join(words, MARK).alias("text")), cut))


def word_ids(tokens, width: int = 4, specials: bool = True) -> Column:
    """Word index of each sub-token ([CLS]/[SEP] positions get NULL)."""
    ids = F.flatten(F.transform(_c(tokens), lambda w, i: F.array_repeat(
        i, F.greatest(F.ceil(F.length(w) / width).cast("int"), F.lit(1)))))
    if not specials:
        return ids
    null = F.array(F.lit(None).cast("int"))
    return F.concat(null, ids, null)


def group_subwords(df: DataFrame, id_col: str, pieces: str, prefix: str = SUBWORD_PREFIX,
                   specials=("[CLS]", "[SEP]", "[PAD]"), only: str | None = None) -> DataFrame:
    """(id, word_no, word, idx) from sub-tokens: specials skipped, '##' continues a word.

    Sentence-local: word starts and their ends (the next start or special) are found with
    array functions inside the row, then exploded; no window, no shuffle.  The words are cut from the
    sentence as one text, or put together one by one where a piece is null or holds the mark between pieces.
    With ``only`` (a column) the words that equal it in lower case are left, under their numbers.
    """
    p = F.col(pieces)
    # borders: places of pieces that start a word, and of specials as -1 - place
    borders = F.filter(F.transform(p, lambda x, i: F.when(x.isin(*specials), -1 - i).when(
        ~x.startswith(prefix), i)), lambda i: i.isNotNull())
    text = F.array_join(p, MARK)
    # a mark between any two pieces, and none elsewhere
    plain = F.lit(not any(x.startswith(prefix) or MARK in x for x in specials)) & ~F.exists(p, lambda x: x.isNull()) & (
        F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit(""))) == F.size(p) - 1)
    cut = F.split(F.replace(F.concat(F.lit(MARK), text), F.lit(MARK + prefix), F.lit("")), MARK, -1)

    def words(x):
        def one(b, j):
            end = F.coalesce(F.get(x["b"], j + 1), F.size(x["p"]))
            end = F.when(end < 0, -1 - end).otherwise(end)
            # before the first mark stand only pieces that continue nothing
            word = F.when(x["plain"], F.get(x["cut"], j + 1)).otherwise(F.array_join(F.transform(
                F.slice(x["p"], b + 1, end - b), lambda y: F.regexp_replace(y, "^" + prefix, "")), ""))
            return F.when(b >= 0, F.struct(b.alias("s"), end.alias("e"), word.alias("word")))
        found = F.filter(F.transform(x["b"], one), lambda w: w.isNotNull())
        if only is None:
            return found
        return F.filter(F.transform(found, lambda w, no: F.struct(no.alias("no"), w["s"].alias("s"), w["e"].alias("e"),
                                                                  w["word"].alias("word"))),
                        lambda w: F.lower(w["word"]) == x["only"])
    row = F.struct(p.alias("p"), borders.alias("b"), plain.alias("plain"), F.when(plain, cut).alias("cut"),
                   *([] if only is None else [F.lower(only).alias("only")]))
    found = let(row, words)
    e = df.select(id_col, F.posexplode(found).alias("word_no", "_w")) if only is None else \
        df.select(id_col, F.explode(found).alias("_w")).withColumn("word_no", F.col("_w.no"))
    return e.select(id_col, "word_no", F.col("_w.word").alias("word"),
                    F.sequence(F.col("_w.s"), F.col("_w.e") - 1).alias("idx"))


def pool_word_vector(groups: DataFrame, token_vectors: DataFrame, keywords: DataFrame,
                     id_col: str, mode: str = "mean") -> DataFrame:
    """Vector of the first occurrence of lower(keyword) among a sentence's words: mean over
    its sub-token vectors (or the first one); absent word -> no row."""
    g = groups.join(keywords.select(id_col, F.lower("keyword").alias("_kw")), id_col) \
        .where(F.lower("word") == F.col("_kw"))
    first = g.groupBy(id_col).agg(F.min_by("idx", "word_no").alias("idx"))
    if mode == "first":
        first = first.withColumn("idx", F.slice("idx", 1, 1))
    sub = first.select(id_col, F.explode("idx").alias("pos"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    j = sub.join(token_vectors, [id_col, "pos"]).withColumn("_v", array_to_vector(F.col("vec").cast("array<double>")))
    return j.groupBy(id_col).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n_subtokens")) \
        .select(id_col, vector_to_array("_m").alias("vector"), "n_subtokens")


# --- T2-T4 alignment ------------------------------------------------------------------------------

def align_labels(wids, labels, lmap, all_tokens: bool = False) -> Column:
    """Label id per sub-token: NULL word id -> -100; first sub-token of a word -> its label id
    (-101 if the label is not in the map); later sub-tokens -> -100 (or the label again)."""
    lmap = _c(lmap)

    def aligned(x):
        ids, names = x["ids"], x["names"]

        def one(w, j):
            lab = F.coalesce(F.element_at(lmap, F.get(names, w)), F.lit(UNSEEN))
            prev = F.when(j > 0, F.get(ids, j - 1))
            first = (j == 0) | ~prev.eqNullSafe(w)
            later = lab if all_tokens else F.lit(IGNORE)
            return F.when(w.isNull(), F.lit(IGNORE)).when(first, lab).otherwise(later)
        return F.transform(ids, one)
    # named once: where the arrays are expressions, the optimiser would paste them into every sub-token
    return let(F.struct(_c(wids).alias("ids"), _c(labels).alias("names")), aligned)


def truncate_tokens(col, n: int = 512) -> Column:
    return F.slice(_c(col), 1, n)


def strip_ignored(labels, preds) -> Column:
    """Pairs (label, pred) whose label is not the ignore id."""
    z = F.arrays_zip(_c(labels).alias("l"), _c(preds).alias("p"))
    return F.filter(z, lambda x: x["l"] != IGNORE)


def argmax_label(scores, labels) -> Column:
    """Label at the first maximum of each token's score array."""
    return F.transform(_c(scores), lambda s: F.get(_c(labels), F.array_position(s, F.array_max(s)).cast("int") - 1))


# --- T5-T7 metrics ----------------------------------------------------------------------------------

def token_metrics(df: DataFrame, tags: str = "tags", preds: str = "preds") -> DataFrame:
    """Per-tag precision/recall/F1 and overall token accuracy (tag 'overall')."""
    z = F.arrays_zip(F.col(tags).alias("t"), F.col(preds).alias("p"))
    # one pass over the tokens: each counts for its tag and for its prediction
    e = df.select(F.explode(z).alias("z")).groupBy(F.col("z.t").alias("t"), F.col("z.p").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = e.select(F.explode(F.array(
        F.struct(F.col("t").alias("tag"), F.col("n").alias("g"), F.lit(0).cast("long").alias("q"), hit.alias("h")),
        F.struct(F.col("p").alias("tag"), F.lit(0).cast("long").alias("g"), F.col("n").alias("q"),
                 F.lit(0).cast("long").alias("h")))).alias("s"))
    j = sides.groupBy(F.col("s.tag").alias("tag")).agg(
        F.sum("s.g").alias("n_true"), F.sum("s.h").alias("tp"), F.sum("s.q").alias("n_pred"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    per = j.select("tag", p.alias("precision"), r.alias("recall"),
                   F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
                   F.col("n_true").alias("support"))
    acc = e.agg((F.sum(F.when((F.col("t") == F.col("p")).isNotNull(), hit))
                 / F.sum(F.when((F.col("t") == F.col("p")).isNotNull(), F.col("n")))).alias("accuracy"))
    return per, acc


def bio_chunks(tags) -> Column:
    """Array of (start, end, tag) of the BIO chunks of a tag array, end exclusive; null: none.

    B-X starts a chunk of type X, and so does I-X where the tag before is not of type X; tags without
    these prefixes are outside.  Every tag is looked at with the one before it; a place where a chunk
    starts, or where one ends outside, is a border, and a chunk reaches to the next border."""
    tags = F.coalesce(_c(tags), F.array().cast("array<string>"))
    begins = lambda t: F.coalesce(t.startswith("B-"), F.lit(False))
    kinds = F.transform(tags, lambda t: F.struct(F.when(t.startswith("B-") | t.startswith("I-"), F.substring(
        t, 3, 1 << 20)).alias("tag"), begins(t).alias("begins")))
    outside = F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.lit(False).alias("begins")))

    def mark(x, i):
        now, was = x["now"], x["was"]
        return F.struct(i.alias("at"), now["tag"].alias("tag"), (now["tag"].isNotNull() & (
            now["begins"] | ~was["tag"].eqNullSafe(now["tag"]))).alias("new"), was["tag"].alias("was"))
    # each tag with the one before it; one longer, as a chunk may end with the sentence
    marks = let(kinds, lambda k: F.transform(F.arrays_zip(
        F.concat(k, outside).alias("now"), F.concat(outside, k).alias("was")), mark))
    borders = F.filter(marks, lambda m: m["new"] | (m["tag"].isNull() & m["was"].isNotNull()))
    chunks = let(borders, lambda b: F.zip_with(b, F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.struct(
        x["at"].alias("start"), y["at"].alias("end"), x["tag"].alias("tag"), x["new"].alias("new"))))
    return F.transform(F.filter(chunks, lambda c: c["new"]), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["tag"].alias("tag")))


def _chunk_rows(col: pa.ListArray, kinds: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, start, length, kind) of the chunks (``bio_chunks``) of a batch of tag arrays, by sentence and start;
    ``kinds`` numbers the types and grows."""
    lens = col.value_lengths().fill_null(0).to_numpy()
    tags = col.flatten().dictionary_encode()
    names = tags.dictionary.to_pylist()
    # the last entry stands for null, which is outside like any tag without a prefix
    number = np.array([kinds.setdefault(t[2:], len(kinds)) if t is not None and t[:2] in ("B-", "I-") else -1
                       for t in [*names, None]])
    starter = np.array([t is not None and t[:2] == "B-" for t in [*names, None]])
    at = tags.indices.fill_null(len(names)).to_numpy()
    kind, first = number[at], np.zeros(len(at), bool)
    begin = np.cumsum(lens) - lens
    first[begin[lens > 0]] = True
    before = np.concatenate([[-1], kind[:-1]])[:len(kind)]
    before[first] = -1
    new = (kind >= 0) & (starter[at] | (before != kind))
    borders = np.flatnonzero(new | first | (kind < 0))
    own = np.flatnonzero(new[borders])
    starts = borders[own]
    ends = np.concatenate([borders, [len(kind)]])[own + 1]
    sentence = np.repeat(np.arange(len(lens)), lens)[starts]
    return sentence, starts - begin[sentence], ends - starts, kind[starts]


def _count_entities(batches):
    """(tag, n_true, n_pred, tp) of the sentences of a task, a row a type."""
    kinds: dict[str, int] = {}
    total = np.zeros((0, 3), np.int64)
    for batch in batches:
        gold, told = (_chunk_rows(c, kinds) for c in batch.columns)
        # chunks of a sentence begin at different places: sentence and start name one
        wide = 1 + max([int(x[1].max()) for x in (gold, told) if len(x[1])], default=0)
        _, g, p = np.intersect1d(*(x[0] * wide + x[1] for x in (gold, told)), assume_unique=True, return_indices=True)
        right = (gold[2][g] == told[2][p]) & (gold[3][g] == told[3][p])
        counts = [np.bincount(x, minlength=len(kinds)) for x in (gold[3], told[3], gold[3][g][right])]
        total = np.vstack([total, np.zeros((len(kinds) - len(total), 3), np.int64)]) + np.stack(counts, axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.string()), *[pa.array(c) for c in total.T]],
                                     names=["tag", "n_true", "n_pred", "tp"])


def entity_metrics(df: DataFrame, id_col: str | None = None, tags: str = "tags", preds: str = "preds"):
    """The same at the level of BIO chunks (``bio_chunks``): (per type, overall) precision, recall, F1 and
    support.  A predicted chunk is right if start, end and type are a gold chunk's.

    A row is a sentence (``id_col`` is not looked at): the chunks of a batch of sentences are found and compared
    at once, and what is shuffled are the counts of each type."""
    per = df.select(tags, preds).mapInArrow(_count_entities, "tag string, n_true long, n_pred long, tp long") \
        .groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")])
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    scored = [p.alias("precision"), r.alias("recall"),
              F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
              F.coalesce("n_true", F.lit(0)).alias("support")]
    overall = per.agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))
    return per.select("tag", *scored), overall.select(*scored)


def flatten_metrics(per: DataFrame) -> DataFrame:
    """Long (tag, metric, value): native long format instead of 'tag_metric' keys."""
    return per.select("tag", F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)"))


def sentence_scores(tokens, tags, preds, known) -> list[Column]:
    """n_tokens, n_labels (tags known to the label map), n_true (tag == pred) per sentence."""
    z = F.arrays_zip(_c(tags).alias("t"), _c(preds).alias("p"))
    return [F.size(_c(tokens)).alias("n_tokens"),
            F.size(F.filter(_c(tags), lambda t: F.array_contains(_c(known), t))).alias("n_labels"),
            F.size(F.filter(z, lambda x: x["t"] == x["p"])).alias("n_true")]


# --- T8-T10 known / unknown words -----------------------------------------------------------------

def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).distinct()


def _tagged_tokens(test: DataFrame, labels: DataFrame | None, keep, tokens, tags, preds) -> DataFrame:
    z = F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t"), F.col(preds).alias("p"))
    e = test.select(*keep, F.explode(z).alias("z")).select(
        *keep, F.col("z.w").alias("token"), F.col("z.t").alias("tag"), F.col("z.p").alias("pred"))
    if labels is not None:
        e = e.join(labels.select("tag"), "tag", "left_semi")
    return e.groupBy(*keep, "token", "tag").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("tag") == F.col("pred")).cast("long")).alias("_ok"))


def _by_known(counted: DataFrame, vocab: DataFrame, keep) -> DataFrame:
    v = vocab.select("token").withColumn("_known", F.lit(True))
    e = counted.join(v, "token", "left").withColumn("known", F.coalesce("_known", F.lit(False)))
    return e.groupBy(*keep, "tag", "known").agg(
        F.sum("_n").alias("total"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("correct"))


def oov_counts(test: DataFrame, vocab: DataFrame, id_col: str, labels: DataFrame | None = None,
               tokens: str = "tokens", tags: str = "tags", preds: str = "preds") -> DataFrame:
    """Per (sentence, gold tag, known): token total and correct predictions.  With ``labels`` (the
    label index, column tag), tokens whose gold tag is not in it are skipped."""
    return _by_known(_tagged_tokens(test, labels, [id_col], tokens, tags, preds), vocab, [id_col])


def oov_maps(counts: DataFrame, id_col: str) -> DataFrame:
    """One row a sentence with four maps tag -> count: known_total, unknown_total, known, unknown
    (the last two count correct predictions).  Entries are bounded by the number of tags."""
    def as_map(known, value):
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("known") == known, F.struct("tag", value)))))
    return counts.groupBy(id_col).agg(
        as_map(True, "total").alias("known_total"), as_map(False, "total").alias("unknown_total"),
        as_map(True, "correct").alias("known"), as_map(False, "correct").alias("unknown"))


def oov_report(test: DataFrame, vocab: DataFrame, labels: DataFrame | None = None,
               tokens: str = "tokens", tags: str = "tags", preds: str = "preds") -> DataFrame:
    """Accuracy per (tag, known) with roll-up totals (NULL = all).  Tokens are counted over the whole
    corpus before they meet the vocabulary: a hot word is one row a tag at the join."""
    counts = _by_known(_tagged_tokens(test, labels, [], tokens, tags, preds), vocab, [])
    return counts.rollup("tag", "known").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct")) \
        .withColumn("accuracy", F.col("correct") / F.col("total"))


def alignment_violations(df: DataFrame, id_col: str, aligned: str, wids: str, tags: str, lmap: str,
                         max_len: int = 512) -> DataFrame:
    """Sentences shorter than max_len without unseen tags whose first-sub-token labels
    differ from the source tags (should be empty)."""
    src = F.transform(F.col(tags), lambda t: F.element_at(F.col(lmap), t))
    differ = let(F.col(aligned), lambda a: ~F.exists(a, lambda x: x == UNSEEN)
                 & (F.filter(a, lambda x: x != IGNORE) != src))
    return df.where((F.size(wids) < max_len) & differ).select(id_col)


def metric_record(train: DataFrame, dev: DataFrame, test: DataFrame, caps=(None, None, None)):
    """Sample counts with optional caps: min(cap, n)."""
    def cnt(df, cap, name):
        c = F.count(F.lit(1))
        return df.agg((F.least(c, F.lit(cap)) if cap else c).alias(name))
    return cnt(train, caps[0], "train_samples").crossJoin(cnt(dev, caps[1], "eval_samples")) \
        .crossJoin(cnt(test, caps[2], "predict_samples"))


# --- M2-M6 mask filling -----------------------------------------------------------------------------

def keyword_rank(cands, kw) -> list[Column]:
    """1-based rank of the keyword among ranked candidates (first match), -1 if absent;
    its score or NULL."""
    pos = F.array_position(F.transform(_c(cands), lambda x: x["token_str"]), _c(kw)).cast("int")
    return [F.when(pos > 0, pos).otherwise(F.lit(-1)).alias("rank"),
            F.when(pos > 0, F.element_at(_c(cands), F.greatest(pos, F.lit(1)))["score"]).alias("score")]


def rank_report(ranks: DataFrame, rank: str = "rank", ks=(1, 5), by=()) -> DataFrame:
    by = _list(by)
    r = F.col(rank)
    aggs = [F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)).alias("mrr")]
    aggs += [F.avg(((r > 0) & (r <= k)).cast("double")).alias(f"hit_at_{k}") for k in ks]
    aggs += [F.avg((r < 0).cast("double")).alias("unranked")]
    return ranks.groupBy(*by).agg(*aggs)


def bigram_model(sentences: DataFrame, tokens: str = "tokens", k: int = 5) -> DataFrame:
    """Top-k next words per previous word by bigram count (ties by word): a built-in,
    deterministic stand-in scorer for mask filling, learnt in Spark."""
    # the lower-cased words are named once, and a pair is a word and the one behind it
    both = let(F.transform(F.col(tokens), lambda x: F.lower(x)), lambda t: F.zip_with(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("prev"), b.alias("word"))))
    pairs = sentences.select(F.explode(both).alias("z"))
    counts = pairs.groupBy(F.col("z.prev").alias("prev"), F.col("z.word").alias("word")) \
        .agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("prev").agg(F.sum("n").alias("_tot"))
    w = Window.partitionBy("prev").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(tot, "prev").select("prev", "word", "rank", (F.col("n") / F.col("_tot")).alias("score"))


def fill_mask(df: DataFrame, model: DataFrame, id_col: str, prev: str = "prev") -> DataFrame:
    """Ranked candidates per row from the bigram model.  The model becomes one row a previous word
    with its <= k candidates first, so rows meet it in one join that keeps their number."""
    lists = model.groupBy(F.col("prev").alias("_prev")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"), F.col("word").alias("token_str"), F.col("score")))).alias("candidates"))
    return join_dim(df.select(id_col, F.col(prev).alias("_prev")), lists, "_prev").select(id_col, "candidates")
