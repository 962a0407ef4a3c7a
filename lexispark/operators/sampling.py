"""Splits and sampling (P1-P17), all keyed by content so results ignore partitioning.

Scale notes
* ``exact_rank`` never sends a whole group to one task: rows are ranked inside
  (group, md5-prefix bucket) cells and offset by a cumulative count over the small
  bucket histogram, which gives the group's size too.  A group holding a third of all rows is
  split into 16**digits cells.
* ``sample_per_group`` keeps the literal ``row_number() <= n`` shape so Spark inserts a
  partial WindowGroupLimit before the shuffle: at most n rows per group leave each map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.keys import hex_bucket, rkey, seeded_int, seeded_unit


def _list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def hex_threshold(frac: float, digits: int = 8) -> str:
    """The md5 prefix below which a fraction ``frac`` of keys fall."""
    frac = min(max(frac, 0.0), 1.0)
    if frac >= 1.0:
        return "g"  # above every hex digit
    return format(int(frac * 16 ** digits), f"0{digits}x")


# --- ranking ------------------------------------------------------------------------------

def exact_rank(df: DataFrame, by, key: Column, id_col: str, out: str = "rank",
               digits: int = 2, size: str | None = None) -> DataFrame:
    """Exact 1-based rank of each row inside its group, ordered by (key, id); with ``size`` also
    the group's number of rows.

    ``key`` must be an md5 hex column.  Rows are ranked in (group, key prefix) cells; a histogram
    of the cells gives each cell's offset and the group's size, so no join is on a bare group.
    Null group keys form a group.
    """
    by = _list(by)
    b = "_bucket"
    keyed = df.withColumn("_key", key).withColumn(b, hex_bucket(F.col("_key"), digits))
    hist = keyed.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_h{i}" for i in range(len(by) + 1)]
    offsets = hist.select(*[F.col(c).alias(n) for c, n in zip([*by, b], names)],
                          F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                          F.sum("_cnt").over(Window.partitionBy(*by)).alias("_all"))
    inner = Window.partitionBy(*by, b).orderBy("_key", id_col)
    ranked = keyed.withColumn("_xrn", F.row_number().over(inner))
    same = None
    for c, n in zip([*by, b], names):
        one = F.col(c).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    ranked = ranked.join(offsets, same).withColumn(out, (F.col("_off") + F.col("_xrn")).cast("bigint"))
    if size:
        ranked = ranked.withColumn(size, F.col("_all").cast("bigint"))
    return ranked.drop("_key", b, "_xrn", "_off", "_all", *names)


SALTS = 8


def join_dim(rows: DataFrame, dim: DataFrame, on, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to a table that has few rows a group.  The table is copied under ``salts`` numbers and
    a row looks up the one that a hash of its own columns gives, so the rows of a hot group are dealt
    over that many tasks, whether or not adaptive execution sees the skew."""
    on = _list(on)
    own = [c for c, kind in rows.dtypes if "map<" not in kind]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def group_sizes(df: DataFrame, by, out: str = "n") -> DataFrame:
    by = _list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def with_group_size(df: DataFrame, by, out: str = "n") -> DataFrame:
    """Attach the group's row count; null keys form a group, a hot one is salted (``join_dim``)."""
    by = _list(by)
    sizes = group_sizes(df, by, out).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], out,
                                            F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_gs"))
    own = [c for c, kind in df.dtypes if "map<" not in kind]
    same = F.pmod(F.xxhash64(*own), F.lit(SALTS)) == F.col("_gs")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(sizes, same).drop("_gs", *[f"_g{i}" for i in range(len(by))])


# --- P1/P2 proportional split --------------------------------------------------------------

def split_by_fraction(df: DataFrame, id_col: str, fractions: Sequence[float] = (0.9, 0.05, 0.05),
                      names: Sequence[str] = ("train", "test", "dev"), seed="split",
                      exact: bool = False, out: str = "role") -> DataFrame:
    """Tag rows with a role.  Approximate: map-only hash thresholds.  Exact: cut points
    ``int(f1*N)``, ``int((f1+f2)*N)``... over the seeded order, as a numpy split would."""
    cum = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]
    if not exact:
        u = seeded_unit(seed, id_col)
        expr = F.lit(names[-1])
        for c, name in reversed(list(zip(cum, names[:-1]))):
            expr = F.when(u < F.lit(c), F.lit(name)).otherwise(expr)
        return df.withColumn(out, expr)
    ranked = exact_rank(df, [], rkey(seed, id_col), id_col, out="_r", size="_n")
    expr = F.lit(names[-1])
    for c, name in reversed(list(zip(cum, names[:-1]))):
        expr = F.when(F.col("_r") <= F.floor(F.col("_n") * F.lit(c)), F.lit(name)).otherwise(expr)
    return ranked.withColumn(out, expr).drop("_r", "_n")


# --- P3/P4 n per group ----------------------------------------------------------------------

def sample_per_group(df: DataFrame, group, n: int | None, seed="sample", id_col: str = "id",
                     short: str = "take") -> DataFrame:
    """n rows per group without replacement, ordered by the seeded key.

    short='take': small groups give all rows; 'drop': groups with < n rows are dropped;
    'error': a small group fails the query (lazily, via raise_error).
    """
    group = _list(group)
    if n is None:
        return df
    w = Window.partitionBy(*group).orderBy(rkey(seed, id_col), F.col(id_col))
    picked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    if short == "take":
        return picked
    sizes = group_sizes(df, group, "_gn")
    if short == "drop":
        return picked.join(sizes.where(F.col("_gn") >= n).select(*group), group, "left_semi")
    if short == "error":
        small = F.raise_error(F.lit(f"group smaller than sample size {n}")).cast("boolean")
        # a filter on the check: an unused column would be pruned and never run
        return picked.join(sizes, group).where(
            F.when(F.col("_gn") < n, small).otherwise(F.lit(True))).drop("_gn")
    raise ValueError(short)


def sample_up_to(df: DataFrame, group, n: int | None, seed="sample", id_col: str = "id"):
    return sample_per_group(df, group, n, seed=seed, id_col=id_col, short="take")


# --- P5/P6/P7 keys --------------------------------------------------------------------------

def split_by_key(df: DataFrame, key: str, frac: float, seed="heldout", out: str = "heldout"):
    """Flag a seeded fraction of key values; every row of a key lands on the same side."""
    return df.withColumn(out, rkey(seed, key) < F.lit(hex_threshold(frac)))


def sample_keys(df: DataFrame, key: str, k: int, seed="keys") -> DataFrame:
    """k distinct key values in seeded order (distinct aggregate + TakeOrdered)."""
    keys = df.select(key).distinct()
    return keys.orderBy(rkey(seed, key), F.col(key)).limit(k)


def select_dev(test: DataFrame, train: DataFrame, zero: DataFrame, key: str = "lemma"):
    """Test rows whose key is in train and not in the zero-shot set."""
    return join_dim(join_dim(test, train.select(key).distinct(), key, "left_semi"),
                    zero.select(key).distinct(), key, "left_anti")


# --- P8/P9/P16 strata ----------------------------------------------------------------------

def eligible_senses(df: DataFrame, lemma: str = "lemma", sense: str = "sense") -> DataFrame:
    """Drop senses with < 2 rows, then lemmas left with < 2 rows or a single sense."""
    sc = df.groupBy(lemma, sense).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= 2)
    lemmas = sc.groupBy(lemma).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_s")) \
        .where((F.col("_n") >= 2) & (F.col("_s") > 1)).select(lemma)
    keep = sc.join(lemmas, lemma, "left_semi").select(lemma, sense)
    return join_dim(df, keep, [lemma, sense], "left_semi")


def stratified_split(df: DataFrame, strata, frac: float = 0.5, seed="strat", id_col: str = "id",
                     out: str = "role") -> DataFrame:
    """Per stratum of n rows: the first max(1, ceil(n*frac)) (at most n-1) in seeded order
    are 'train', the rest 'test'.  Every stratum with >= 2 rows has both sides."""
    strata = _list(strata)
    ranked = exact_rank(df, strata, rkey(seed, id_col), id_col, out="_r", size="_n")
    cut = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(frac))))
    return ranked.withColumn(out, F.when(F.col("_r") <= cut, "train").otherwise("test")) \
        .drop("_n", "_r")


def lemma_halves(df: DataFrame, lemma: str = "lemma", sense: str = "sense", seed="halves",
                 id_col: str = "id") -> DataFrame:
    """Singleton senses dropped, then a 50/50 support/query split per (lemma, sense)."""
    sc = df.groupBy(lemma, sense).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= 2)
    kept = join_dim(df, sc.select(lemma, sense), [lemma, sense], "left_semi")
    return stratified_split(kept, [lemma, sense], 0.5, seed=seed, id_col=id_col) \
        .withColumn("role", F.when(F.col("role") == "train", "support").otherwise("query"))


# --- P10 --------------------------------------------------------------------------------

def wsd_splits(df: DataFrame, depths: Sequence[int], numbering: str = "numbering",
               lemma: str = "lemma", id_col: str = "id", zero_frac: float = 0.1,
               seed="wsd") -> DataFrame:
    """One tagged table (depth, zero, role, ...) over all requested depths."""
    from lexispark.functions.text import depth_key
    parts = []
    for d in depths:
        keyed = df.withColumn("sense", depth_key(numbering, d, ".")).withColumn("depth", F.lit(d))
        el = eligible_senses(keyed, lemma, "sense")
        el = split_by_key(el, lemma, zero_frac, seed=f"{seed}-zero", out="zero")
        parts.append(stratified_split(el, [lemma, "sense"], 0.5, seed=f"{seed}-{d}",
                                      id_col=id_col))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- P11 few-shot draws ---------------------------------------------------------------------

def fewshot_draws(train: DataFrame, strata, iterations: int = 20,
                  sizes: Sequence[int] = (1, 2, 5, 10, 15, 25), seed="fewshot",
                  id_col: str = "id", full: bool = True) -> DataFrame:
    """For each iteration, up to n rows per stratum for every n in ``sizes`` (draws nest).

    One seeded ranking per iteration, pruned at max(sizes) by a window-group limit, then a
    range join with the tiny size table.  Output: (n_items STRING, iteration, *train cols);
    the 'full' draw is iteration 0 with every train row.
    """
    strata = _list(strata)
    spark = train.sparkSession
    its = spark.range(iterations).select(F.col("id").cast("int").alias("iteration"))
    top = max(sizes)
    w = Window.partitionBy("iteration", *strata).orderBy(
        rkey(seed, "iteration", id_col), F.col(id_col))
    # only ids and strata are multiplied; the other columns join the drawn rows
    ranked = (train.select(id_col, *strata).crossJoin(F.broadcast(its))
              .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top))
    size_t = spark.createDataFrame([(int(s),) for s in sizes], "n int")
    drawn = ranked.join(F.broadcast(size_t), F.col("_rn") <= F.col("n")) \
        .withColumn("n_items", F.col("n").cast("string")).select(id_col, "iteration", "n_items")
    drawn = train.join(drawn, id_col)
    if full:
        drawn = drawn.unionByName(train.withColumn("iteration", F.lit(0))
                                  .withColumn("n_items", F.lit("full")))
    return drawn


# --- P12 file splits --------------------------------------------------------------------------

def split_files(df: DataFrame, file_col: str, test_names: Sequence[str], dev_frac: float = 0.05,
                sizes: Sequence[int | None] = (50, 100, 150, 200, None), seed="files") -> DataFrame:
    """File-level splits: fixed test list, a seeded dev fraction, and a nested ladder of
    train sizes (None = all).  Returns the file dimension (file, role, size) — join it back
    with a broadcast semi-join (it has one row per file and size)."""
    spark = df.sparkSession
    files = df.select(file_col).distinct()
    test_t = spark.createDataFrame([(n,) for n in test_names], f"{file_col} string")
    files = files.join(F.broadcast(test_t.withColumn("_test", F.lit(True))), file_col, "left")
    files = files.withColumn("_dev", rkey(seed, file_col) < F.lit(hex_threshold(dev_frac)))
    role = F.when(F.col("_test").isNotNull(), "test").when(F.col("_dev"), "dev").otherwise("train")
    files = files.withColumn("role", role).drop("_test", "_dev")
    w = Window.partitionBy("role").orderBy(rkey(seed, file_col), F.col(file_col))
    files = files.withColumn("_rank", F.row_number().over(w))
    size_t = spark.createDataFrame([(s if s is None else int(s), "full" if s is None else str(s))
                                    for s in sizes], "n int, size string")
    train = files.where(F.col("role") == "train").join(
        F.broadcast(size_t), F.col("n").isNull() | (F.col("_rank") <= F.col("n")))
    other = files.where(F.col("role") != "train").crossJoin(F.broadcast(size_t))
    return train.unionByName(other).select(file_col, "role", "size")


# --- P13 -------------------------------------------------------------------------------------

def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    return df.orderBy(order_col).limit(n)


# --- P15 weighted sampling ------------------------------------------------------------------

def weighted_sample(df: DataFrame, group, weight: Column | str, n: int, seed="weighted",
                    id_col: str = "id") -> DataFrame:
    """Efraimidis-Spirakis: key = -ln(u)/w, keep the n smallest keys per group."""
    group = _list(group)
    w_col = F.col(weight) if isinstance(weight, str) else weight
    u = F.greatest(seeded_unit(seed, id_col), F.lit(1e-12))
    keyed = df.withColumn("_es", -F.log(u) / w_col)
    win = Window.partitionBy(*group).orderBy("_es", id_col)
    return keyed.withColumn("_rn", F.row_number().over(win)).where(F.col("_rn") <= n) \
        .drop("_rn", "_es")


def sense_weight(df: DataFrame, sense, mode: str = "uniform") -> DataFrame:
    """Row weight from its sense's size: 1/count ('uniform') or count ('proportional').  ``sense``
    names the columns that tell a sense apart, the lemma included: labels repeat over lemmas."""
    sized = with_group_size(df, sense, "_sc")
    w = 1.0 / F.col("_sc") if mode == "uniform" else F.col("_sc").cast("double")
    return sized.withColumn("weight", w).drop("_sc")


# --- P17 batches ----------------------------------------------------------------------------

def assign_batches(df: DataFrame, size: int, seed="batches", id_col: str = "id",
                   out: str = "batch") -> DataFrame:
    """Shuffled mini-batches of exactly ``size`` rows (last one shorter)."""
    ranked = exact_rank(df, [], rkey(seed, id_col), id_col, out="_r")
    return ranked.withColumn(out, F.floor((F.col("_r") - 1) / size).cast("bigint")).drop("_r")


# --- P14 episodes ---------------------------------------------------------------------------

#: Primes for permutations i -> (offset + i * prime) mod n of a group's row indices.
PRIMES = (2147483647, 4294967291, 1000000007, 1000000009, 998244353, 999999937, 4294967279, 2147483629)
LAST_PRIME = (1 << 61) - 1


def sample_episodes(df: DataFrame, n_episodes: int, lemma: str = "lemma", sense: str = "sense",
                    id_col: str = "id", strategy: str = "uniform", max_support: int | None = None,
                    max_query: int | None = None, attempts: int = 10, seed="episodes"):
    """Few-shot episodes: draw a lemma per episode (uniform over lemmas or by row frequency),
    split its senses 50/50 into support and query, cap the support, keep query rows whose sense
    is in the capped support, cap these; retry up to ``attempts`` draws and keep the first with a
    query.

    Rows are ranked once per (lemma, sense), skew-safe; an episode permutes these indices by a
    prime and an offset of its own and fetches only the positions it needs, so its work is bounded
    by senses x caps, not by the size of the lemma.  Caps of None mean all rows.

    Output: the columns of ``df`` with episode, attempt, role.
    """
    spark = df.sparkSession
    sc = df.groupBy(lemma, sense).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= 2)
    dim = sc.groupBy(lemma).agg(F.sum("_c").alias("_n"))
    dim = exact_rank(dim, [], rkey(f"{seed}-lemma", lemma), lemma, out="_li", size="_L")
    draws = spark.range(n_episodes).select(F.col("id").alias("episode")).crossJoin(
        spark.range(attempts).select(F.col("id").cast("int").alias("attempt")))
    if strategy == "uniform":
        one = dim.agg(F.count(F.lit(1)).alias("_L"))
        draws = draws.crossJoin(F.broadcast(one)).where("_L > 0")   # one row
        chosen = draws.withColumn("_pick", F.pmod(seeded_int(seed, "episode", "attempt"), "_L") + 1) \
            .join(dim.select(lemma, "_li"), F.col("_pick") == F.col("_li"))
    else:
        # a row drawn uniformly names its lemma: ranks over all rows of all lemmas
        rows = exact_rank(join_dim(df, sc.select(lemma, sense), [lemma, sense], "left_semi")
                          .select(lemma, id_col), [], rkey(f"{seed}-row", id_col), id_col, out="_ri")
        one = dim.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"))
        draws = draws.crossJoin(F.broadcast(one)).where("_rows > 0")   # one row
        chosen = draws.withColumn("_pick", F.pmod(seeded_int(seed, "episode", "attempt"), "_rows") + 1) \
            .join(rows.select(lemma, "_ri"), F.col("_pick") == F.col("_ri"))
    chosen = chosen.select("episode", "attempt", lemma)
    ranked = exact_rank(join_dim(df, sc.select(lemma, sense), [lemma, sense], "left_semi"), [lemma, sense],
                        rkey(seed, id_col), id_col, out="_r").withColumn("_r0", F.col("_r") - 1).drop("_r")
    n = F.col("_c")
    prime = F.element_at(F.array(*[F.lit(p).cast("bigint") for p in PRIMES]), (F.pmod(
        seeded_int(f"{seed}-prime", "episode", "attempt", sense), F.lit(len(PRIMES))) + 1).cast("int"))
    strata = chosen.join(sc, lemma).withColumn("_a", prime).withColumn(
        "_a", F.when(F.pmod("_a", n) == 0, F.lit(LAST_PRIME)).otherwise(F.col("_a"))).withColumn(
        "_o", F.pmod(seeded_int(seed, "episode", "attempt", sense), n)).withColumn(
        "_cut", F.least(n - 1, F.greatest(F.lit(1), F.ceil(n * 0.5))).cast("bigint"))

    def positions(role, first, last):
        """Permuted row indices of positions first..last - 1."""
        at = strata.where(last > first).select(
            "episode", "attempt", lemma, sense, "_c", "_o", "_a", F.lit(role).alias("role"),
            F.explode(F.sequence(first, last - 1)).alias("_t"))
        big = lambda c: F.col(c).cast("decimal(38,0)")
        return at.select("episode", "attempt", lemma, sense, "role", (
            (big("_o") + big("_t") * big("_a")) % big("_c")).cast("bigint").alias("_r0"))

    def capped(rows, cap):
        if cap is None:
            return rows
        w = Window.partitionBy("episode", "attempt").orderBy(
            rkey(seed + "-cap", "episode", "attempt", id_col), id_col)
        return rows.withColumn("_cp", F.row_number().over(w)).where(F.col("_cp") <= cap).drop("_cp")

    cut = F.col("_cut")
    zero = F.lit(0).cast("bigint")
    sup = positions("support", zero, cut if max_support is None else F.least(cut, F.lit(max_support)))
    qry = positions("query", cut, n if max_query is None else F.least(n, cut + max_query))
    sup = capped(sup.join(ranked, [lemma, sense, "_r0"]).drop("_r0"), max_support)
    have = sup.select("episode", "attempt", sense).distinct()
    qry = qry.join(have, ["episode", "attempt", sense], "left_semi")
    qry = capped(qry.join(ranked, [lemma, sense, "_r0"]).drop("_r0"), max_query)
    first = qry.groupBy("episode").agg(F.min("attempt").alias("attempt"))
    return sup.unionByName(qry).join(first, ["episode", "attempt"], "left_semi")
