"""Joins and pair generation.

No operator here self-joins a group: pairs are drawn by index arithmetic on seeded
hashes and resolved with equi-joins, so the cost is O(rows x draws), never O(group^2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.keys import rkey, seeded_int
from lexispark.operators.sampling import _list, group_sizes, join_dim

def index_within(df: DataFrame, group, id_col: str, seed, out: str) -> DataFrame:
    """0-based seeded position of each row inside its group (random but reproducible)."""
    from lexispark.operators.sampling import exact_rank
    return exact_rank(df, group, rkey(seed, id_col), id_col, out=out) \
        .withColumn(out, F.col(out) - 1)


# --- J1 --------------------------------------------------------------------------------------

def pair_export(pairs: DataFrame, quotes: DataFrame, cols=("quote", "keyword", "year"),
                id_col: str = "quote_id") -> DataFrame:
    """Attach both sides' columns with _1/_2 suffixes; label and lemma travel by key."""
    q = quotes.select(id_col, *cols)
    a = q.select(F.col(id_col).alias("q1"), *[F.col(c).alias(f"{c}_1") for c in cols])
    b = q.select(F.col(id_col).alias("q2"), *[F.col(c).alias(f"{c}_2") for c in cols])
    return pairs.join(a, "q1").join(b, "q2")


# --- J4/J12 ----------------------------------------------------------------------------------

def with_vectors(pairs: DataFrame, vectors: DataFrame, id_col: str = "id",
                 vec_col: str = "embedding") -> DataFrame:
    """Look up both sides' vectors (q1 and q2 — the reference took q1 twice)."""
    v = vectors.select(id_col, vec_col)
    return (pairs.join(v.select(F.col(id_col).alias("q1"), F.col(vec_col).alias("e1")), "q1")
            .join(v.select(F.col(id_col).alias("q2"), F.col(vec_col).alias("e2")), "q2"))


# --- J5 --------------------------------------------------------------------------------------

def complete_lemmas(test: DataFrame, vectors: DataFrame, keys, id_col: str = "id") -> DataFrame:
    """Key groups (e.g. run, lemma) whose test rows all have a vector."""
    keys = _list(keys)
    have = vectors.select(id_col).distinct().withColumn("_has", F.lit(True))
    return (test.join(have, id_col, "left")
            .groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("_has"), F.lit(False))).alias("_ok"))
            .where("_ok").drop("_ok"))


# --- J6/J7 word-in-context pairs ----------------------------------------------------------------

def multi_sense_lemmas(df: DataFrame, lemma: str = "lemma", sense: str = "sense") -> DataFrame:
    """Rows of lemmas with more than one sense (min != max: no distinct count)."""
    ok = df.groupBy(lemma).agg((F.min(sense) != F.max(sense)).alias("_m")).where("_m")
    return join_dim(df, ok.select(lemma), lemma, "left_semi")


def sense_pairs(df: DataFrame, lemma: str = "lemma", sense: str = "sense", id_col: str = "id",
                nneg: int = 1, npos: int = 1, seed="wic") -> DataFrame:
    """For each row whose sense has >= 2 rows: ``npos`` other rows of its sense (label 1)
    and ``nneg`` rows of one seeded other sense of the lemma (label 0).

    Rows get a seeded index inside (lemma, sense); senses a seeded index inside the lemma.
    Partners are addressed by index and fetched with an equi-join.
    """
    df = multi_sense_lemmas(df, lemma, sense)
    spark = df.sparkSession
    rows = index_within(df, [lemma, sense], id_col, f"{seed}-row", "_rn")
    senses = group_sizes(df, [lemma, sense], "_c")
    senses = index_within(senses.withColumn("_sid", F.col(sense)), [lemma], "_sid",
                          f"{seed}-sense", "_sn")
    n_senses = senses.groupBy(lemma).agg(F.count(F.lit(1)).alias("_s"))
    sdim = senses.join(n_senses, lemma).select(lemma, sense, "_c", "_sn", "_s")
    base = join_dim(rows, sdim, [lemma, sense]).where(F.col("_c") >= 2)
    target = rows.select(F.col(lemma).alias("_tl"), F.col("_rn").alias("_trn"),
                         F.col(sense).alias("_ts"), F.col(id_col).alias("q2"))
    out = []
    if npos > 0:
        t = spark.range(npos).select(F.col("id").cast("int").alias("_t"))
        u = seeded_int(f"{seed}-pos", id_col)
        pos = base.crossJoin(F.broadcast(t)).where(F.col("_t") < F.col("_c") - 1)
        pos = pos.withColumn("_prn", F.pmod(F.col("_rn") + 1 + F.pmod(u + F.col("_t"),
                                                                    F.col("_c") - 1), F.col("_c")))
        pos = pos.join(target, (F.col("_tl") == F.col(lemma)) & (F.col("_ts") == F.col(sense)) &
                       (F.col("_trn") == F.col("_prn")))
        out.append(pos.select(F.col(id_col).alias("q1"), "q2", F.lit(1).alias("label"), lemma))
    if nneg > 0:
        u = seeded_int(f"{seed}-neg", id_col)
        other = F.pmod(F.col("_sn") + 1 + F.pmod(u, F.col("_s") - 1), F.col("_s"))
        neg = base.withColumn("_osn", other)
        od = sdim.select(lemma, F.col("_sn").alias("_osn"), F.col(sense).alias("_os"), F.col("_c").alias("_oc"))
        neg = join_dim(neg, od, [lemma, "_osn"])
        t = spark.range(nneg).select(F.col("id").cast("int").alias("_t"))
        neg = neg.crossJoin(F.broadcast(t)).where(F.col("_t") < F.col("_oc"))
        v = seeded_int(f"{seed}-negrow", id_col)
        neg = neg.withColumn("_prn", F.pmod(v + F.col("_t"), F.col("_oc")))
        neg = neg.join(target, (F.col("_tl") == F.col(lemma)) & (F.col("_ts") == F.col("_os")) &
                       (F.col("_trn") == F.col("_prn")))
        out.append(neg.select(F.col(id_col).alias("q1"), "q2", F.lit(0).alias("label"), lemma))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# --- J8 ---------------------------------------------------------------------------------------

def dedup_pairs(pairs: DataFrame, mode: str = "distinct") -> DataFrame:
    """'none': as generated; 'distinct': one row per unordered id pair (smallest label
    first); 'unique': drop every unordered pair generated more than once."""
    if mode == "none":
        return pairs
    lo, hi = F.least("q1", "q2"), F.greatest("q1", "q2")
    keyed = pairs.withColumn("_lo", lo).withColumn("_hi", hi)
    if mode == "distinct":
        w = Window.partitionBy("_lo", "_hi").orderBy("q1", "q2", "label")
        return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1") \
            .drop("_r", "_lo", "_hi")
    if mode == "unique":
        cnt = keyed.groupBy("_lo", "_hi").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
        return keyed.join(cnt.select("_lo", "_hi"), ["_lo", "_hi"], "left_semi") \
            .drop("_lo", "_hi")
    raise ValueError(mode)


# --- J9/J10 dated pairs -----------------------------------------------------------------------

STEP = (1 << 61) - 1   # a prime above any number of lemma pairs, so steps of it meet each once


def dated_pairs(df: DataFrame, size: int, lemma: str = "lemma", id_col: str = "id",
                seed="dated") -> DataFrame:
    """``size`` pairs of quotes (all, if there are fewer) from two different lemmas: each unordered
    pair of lemmas at most once, one seeded quote from each.

    The L (L - 1) / 2 lemma pairs are numbered; the i-th draw is pair (offset + i * STEP) modulo
    their number, a permutation, so nothing is drawn twice and no product is made.  A number is
    decoded to its two lemma indices, and quotes are addressed by index.
    """
    spark = df.sparkSession
    dim = df.groupBy(lemma).agg(F.count(F.lit(1)).alias("_n"))
    dim = index_within(dim, [], lemma, seed, "_li")
    n_p = dim.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("bigint").alias("_M"))
    draws = spark.range(int(size)).crossJoin(F.broadcast(n_p)).where("id < _M")  # one row
    big = lambda c: c.cast("decimal(38,0)")
    p = ((big(F.pmod(seeded_int(f"{seed}-offset", F.lit("pairs")), F.col("_M")))
          + big(F.col("id")) * big(F.pmod(F.lit(STEP), F.col("_M")))) % big(F.col("_M"))).cast("bigint")
    draws = draws.select(p.alias("_p"))
    i = F.floor((F.sqrt(8.0 * F.col("_p") + 1.0) + 1.0) / 2.0).cast("bigint")
    draws = draws.withColumn("_i", i)
    below = lambda c: (c * (c - 1) / 2).cast("bigint")
    # the square root is off by one at most, far beyond 2^52 pairs
    draws = draws.withColumn("_i", F.when(below(F.col("_i")) > F.col("_p"), F.col("_i") - 1)
                             .when(below(F.col("_i") + 1) <= F.col("_p"), F.col("_i") + 1)
                             .otherwise(F.col("_i")))
    lp = draws.select((F.col("_p") - below(F.col("_i"))).alias("_i"), F.col("_i").alias("_j"))
    da = dim.select(F.col(lemma).alias("lemma_1"), F.col("_li").alias("_i"), F.col("_n").alias("_na"))
    db = dim.select(F.col(lemma).alias("lemma_2"), F.col("_li").alias("_j"), F.col("_n").alias("_nb"))
    lp = lp.join(da, "_i").join(db, "_j")
    lp = lp.withColumn("_ra", F.pmod(seeded_int(f"{seed}-ra", "_i", "_j"), F.col("_na"))) \
        .withColumn("_rb", F.pmod(seeded_int(f"{seed}-rb", "_i", "_j"), F.col("_nb")))
    rows = index_within(df.select(lemma, id_col), [lemma], id_col, f"{seed}-rows", "_rn")
    ra = rows.select(F.col(lemma).alias("lemma_1"), F.col("_rn").alias("_ra"),
                     F.col(id_col).alias("q1"))
    rb = rows.select(F.col(lemma).alias("lemma_2"), F.col("_rn").alias("_rb"),
                     F.col(id_col).alias("q2"))
    return lp.join(ra, ["lemma_1", "_ra"]).join(rb, ["lemma_2", "_rb"]) \
        .select("q1", "q2", "lemma_1", "lemma_2")


def order_label(pairs: DataFrame, y1: str = "y1", y2: str = "y2", out: str = "label"):
    """1 if the first sentence is strictly later, else 0 (ties 0)."""
    return pairs.withColumn(out, (F.col(y1) > F.col(y2)).cast("int"))


# --- J11 contrastive pairs ---------------------------------------------------------------------

def contrastive_pairs(df: DataFrame, label: str = "label", id_col: str = "id", ratio: int = 1,
                      npos: int = 1, seed="contrast") -> DataFrame:
    """Per row: ``npos`` positives drawn from its own label (the row itself may be drawn)
    and ``ratio`` negatives, each from a label drawn uniformly among the other labels."""
    spark = df.sparkSession
    rows = index_within(df, [label], id_col, f"{seed}-row", "_rn")
    dim = group_sizes(df, [label], "_c")
    dim = index_within(dim, [], label, f"{seed}-label", "_li").select(label, "_c", "_li")
    n_l = dim.agg(F.count(F.lit(1)).alias("_L"))
    base = join_dim(rows, dim, label).crossJoin(F.broadcast(n_l))  # n_l is one row
    target = rows.select(F.col(label).alias("_tl"), F.col("_rn").alias("_trn"),
                         F.col(id_col).alias("q2"))
    tp = spark.range(npos).select(F.col("id").cast("int").alias("_t"))
    pos = base.crossJoin(F.broadcast(tp)).withColumn(
        "_prn", F.pmod(seeded_int(f"{seed}-pos", id_col, "_t"), F.col("_c")))
    pos = pos.join(target, (F.col("_tl") == F.col(label)) & (F.col("_trn") == F.col("_prn"))) \
        .select(F.col(id_col).alias("q1"), "q2", F.lit(1).alias("y"))
    tn = spark.range(ratio).select(F.col("id").cast("int").alias("_t"))
    neg = base.where("_L >= 2").crossJoin(F.broadcast(tn)).withColumn(
        "_oli", F.pmod(F.col("_li") + 1 + F.pmod(seeded_int(f"{seed}-lab", id_col, "_t"),
                                                 F.col("_L") - 1), F.col("_L")))
    od = dim.select(F.col(label).alias("_ol"), F.col("_li").alias("_oli"), F.col("_c").alias("_oc"))
    neg = join_dim(neg, od, "_oli").withColumn(
        "_prn", F.pmod(seeded_int(f"{seed}-neg", id_col, "_t"), F.col("_oc")))
    neg = neg.join(target, (F.col("_tl") == F.col("_ol")) & (F.col("_trn") == F.col("_prn"))) \
        .select(F.col(id_col).alias("q1"), "q2", F.lit(0).alias("y"))
    return pos.unionByName(neg)


# --- J13-J15 products with a bounded side --------------------------------------------------------

def spread(items: DataFrame, id_col: str) -> DataFrame:
    """Items dealt by a hash over twice as many tasks as there are cores (a number of its own, which adaptive
    execution does not merge): what follows makes a pool's worth of work of each item."""
    return items.repartition(2 * items.sparkSession.sparkContext.defaultParallelism, F.col(id_col))


def cross_with_background(items: DataFrame, background: DataFrame, direction: str = "forward",
                          item_id: str = "item_id", bg_id: str = "bg_id") -> DataFrame:
    """Every item against every background row, with s1_id, s2_id (which sentence comes first:
    the item forward, the background row backward) and direction.

    The background is a pool of a fixed number of rows per time bin, so it is broadcast; items are
    spread over tasks by a hash, however few files they come from, and stream through."""
    if direction not in ("forward", "backward"):
        raise ValueError(direction)
    first, second = (item_id, bg_id) if direction == "forward" else (bg_id, item_id)
    return (spread(items, item_id).crossJoin(F.broadcast(background))
            .withColumn("s1_id", F.col(first)).withColumn("s2_id", F.col(second))
            .withColumn("direction", F.lit(direction)))


def _per_span(df: DataFrame, year: str, span: int, n: int, id_col: str, seed) -> DataFrame:
    """At most n seeded rows of each span, numbered from 1 (a window-group limit runs first)."""
    from lexispark.functions.text import year_bin
    binned = df.select(F.col(id_col).alias("_id"), F.col(year).alias("_year"),
                       year_bin(year, span).alias("_bin"))
    w = Window.partitionBy("_bin").orderBy(rkey(seed, "_id"), "_id")
    return binned.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def span_product(df: DataFrame, year: str, span: int, n: int, id_col: str = "id",
                 seed="span") -> DataFrame:
    """n seeded rows of each year span are split in two halves (the second is the larger one);
    the first halves of all spans together meet the second halves of all spans.  Both sides have
    n / 2 rows a span, which bounds what is broadcast."""
    picked = _per_span(df, year, span, n, id_col, seed)
    size = picked.groupBy(F.col("_bin").alias("_b")).agg(F.max("_r").alias("_m"))
    picked = picked.join(size, F.col("_bin") == F.col("_b"))
    half = F.floor(F.col("_m") / 2)
    left = picked.where(F.col("_r") <= half).select(
        F.col("_id").alias("a_id"), F.col("_year").alias("a_year"), F.col("_bin").alias("a_span"))
    right = picked.where(F.col("_r") > half).select(
        F.col("_id").alias("b_id"), F.col("_year").alias("b_year"), F.col("_bin").alias("b_span"))
    return left.crossJoin(F.broadcast(right))


def background_product(bg: DataFrame, year: str, span: int, n: int, id_col: str = "id",
                       seed="bgprod") -> DataFrame:
    """n per span sampled twice with the same seed (so the same rows), crossed: self-pairs
    occur, as in the reference.  Either side has n rows a span, which bounds the broadcast."""
    s = _per_span(bg, year, span, n, id_col, seed)
    a = s.select(F.col("_id").alias("a_id"), F.col("_year").alias("a_year"))
    b = s.select(F.col("_id").alias("b_id"), F.col("_year").alias("b_year"))
    return a.crossJoin(F.broadcast(b))


# --- J17 ---------------------------------------------------------------------------------------

def common_vocab(vocabs: DataFrame, token: str = "token", model: str = "model") -> DataFrame:
    """Tokens present in every model's vocabulary."""
    m = vocabs.agg(F.countDistinct(model).alias("_m"))
    per = vocabs.groupBy(token).agg(F.countDistinct(model).alias("_k"))
    return per.crossJoin(F.broadcast(m)).where(F.col("_k") == F.col("_m")).select(token)
