"""Stand-in inputs derived from the driver tables, in the reference's data model.

Each builder reads the given tables, so its size grows with them.  The matching DuckDB
statements (``DUCK``) are used by the SQL oracles; both engines produce identical rows.

Deviations from a literal reading of the fixture notes, taken so the work covers whole
tables and whole texts:
* ``tagged`` keeps every token of a document (no prefix cut);
* ``scores``: every vector is an item, and at most BG_PER_DECADE vectors a decade, drawn from all of
  them, are the pool (an item that was drawn meets itself like any other row);
* ``dating_items`` and ``background_pool`` (``score_background`` only) are disjoint: a quarter of the
  vectors (by hash) is set aside as background, and the vectors outside it are the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.keys import rkey, seeded_unit
from lexispark.sources.tables import dealt, table

# Fixed values of the stand-in data (both engines must agree on them).
BG_PER_DECADE = 20         # background pool size per decade (the reference's)
BG_PART = "40000000"       # keys below are the background part: a quarter


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return spark.sql("""
        select o_orderkey as quote_id, p_name as lemma,
          concat(p_name, case when o_orderkey % 37 = 0 then '†' else '' end, ', ',
            case o_orderkey % 7 when 0 then 'adv' when 1 then 'v' when 2 then 'adj' else 'n' end,
            '.') as word,
          concat(cast(1 + (o_orderkey % 13) % 3 as string), '.',
            cast(1 + (o_orderkey % 17) % 2 as string),
            case when o_orderkey % 5 = 0 then '.a.' else '' end) as numbering,
          concat('Thou seest the ', p_name, ' of ', o_orderstatus, ' in ', lower(p_type),
            ' manner') as quote,
          case when o_orderkey % 29 = 0 then 'absent' else split_part(p_name, ' ', 1) end as keyword,
          cast(1440 + o_orderkey % 520 as int) as year,
          cast(1 + o_orderkey % 23 as int) as n_words
        from {orders} cross join {n_part} join {part} on p_partkey = o_orderkey % n_part
    """, orders=orders, part=part, n_part=F.broadcast(part.agg(F.count(F.lit(1)).alias("n_part"))))


def sense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    lemma = F.concat(F.lit("L"), F.col("label").cast("string"))
    return emb.select(
        F.col("vec_id").alias("quote_id"),
        lemma.alias("lemma"),
        F.concat(lemma, F.lit("+"), (F.col("vec_id") % 3).cast("string")).alias("sense"),
        (F.lit(1450) + (F.col("vec_id") * 7) % 500).cast("int").alias("year"),
        F.col("embedding"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders", "o_orderkey").alias("a")
    b = table(spark, sf_dir, "orders", "o_orderkey").alias("b")
    year = lambda k: (F.lit(1451) + (k * 31) % 498).cast("int")
    return a.join(b, F.col("b.o_orderkey") == F.col("a.o_orderkey") + 1).select(
        F.col("a.o_orderkey").alias("pair_id"),
        F.concat(F.lit("s"), F.col("a.o_orderkey").cast("string")).alias("s1"),
        F.concat(F.lit("s"), F.col("b.o_orderkey").cast("string")).alias("s2"),
        year(F.col("a.o_orderkey")).alias("y1"),
        year(F.col("b.o_orderkey")).alias("y2"),
    )


def dating_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors outside the background part."""
    emb = table(spark, sf_dir, "embeddings", "vec_id")
    return emb.where(rkey("bgpart", "vec_id") >= BG_PART).select(
        F.col("vec_id").alias("item_id"),
        (F.lit(1450) + (F.col("vec_id") * 13) % 500).cast("int").alias("item_year"))


def _drawn(vectors: DataFrame) -> DataFrame:
    from lexispark.operators.sampling import sample_per_group
    rest = vectors.select(
        F.col("vec_id").alias("bg_id"),
        (F.lit(1450) + F.lit(10) * (F.col("vec_id") % 50)).cast("int").alias("bg_year"))
    return sample_per_group(rest, "bg_year", BG_PER_DECADE, seed="bg", id_col="bg_id")


def background_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most BG_PER_DECADE vectors per decade of the background part (bounded)."""
    emb = table(spark, sf_dir, "embeddings", "vec_id")
    return _drawn(emb.where(rkey("bgpart", "vec_id") < BG_PART))


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors."""
    return table(spark, sf_dir, "embeddings", "vec_id").select(
        F.col("vec_id").alias("item_id"),
        (F.lit(1450) + (F.col("vec_id") * 13) % 500).cast("int").alias("item_year"))


def drawn_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most BG_PER_DECADE vectors per decade of all vectors (bounded)."""
    return _drawn(table(spark, sf_dir, "embeddings", "vec_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.operators.pairs import cross_with_background
    cross = cross_with_background(scored_items(spark, sf_dir), drawn_pool(spark, sf_dir))
    u = seeded_unit("sc", "item_id", "bg_id")
    score = F.when(F.col("item_year") > F.col("bg_year"), F.lit(0.5) + F.lit(0.5) * u) \
        .otherwise(F.lit(0.6) * u)
    return cross.select("item_id", "bg_id", "item_year", "bg_year", score.alias("score"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id")
    return spark.sql("""
        select doc_id as sent_id, source, tokens,
          transform(tokens, x -> concat('T', cast(length(x) % 5 as string))) as tags,
          transform(tokens, x -> case when md5(concat(cast(doc_id as string), x)) < '33' then 'T0'
            else concat('T', cast(length(x) % 5 as string)) end) as preds
        from (select doc_id, source, filter(split(text, '[^\\\\p{{L}}]+'), x -> length(x) > 0) as tokens
              from {docs})
    """, docs=docs)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ranked candidates for the keyword of each quotation, from the words of all part names (one row
    holds that vocabulary)."""
    part = table(spark, sf_dir, "part", "p_name")
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().agg(
        F.array_sort(F.collect_list("w")).alias("words"))
    return spark.sql("""
        select quote_id, keyword as kw, transform(sequence(0, 4), i -> named_struct(
          'token_str', words[cast((quote_id * 5 + i * 3) % size(words) as int)],
          'score', 1D / (i + 2))) as candidates
        from {quotes} cross join {words}
    """, quotes=quotes(spark, sf_dir), words=F.broadcast(words))


# ---------------------------------------------------------------------------------------
# DuckDB forms of the same fixtures, as CTE bodies (tables are pre-registered views).
DUCK = {
    "quotes": """
        select o_orderkey as quote_id, p_name as lemma,
          concat(p_name, case when o_orderkey % 37 = 0 then '†' else '' end, ', ',
            case o_orderkey % 7 when 0 then 'adv' when 1 then 'v' when 2 then 'adj' else 'n' end,
            '.') as word,
          concat(cast(1 + (o_orderkey % 13) % 3 as varchar), '.',
            cast(1 + (o_orderkey % 17) % 2 as varchar),
            case when o_orderkey % 5 = 0 then '.a.' else '' end) as numbering,
          concat('Thou seest the ', p_name, ' of ', o_orderstatus, ' in ', lower(p_type),
            ' manner') as quote,
          case when o_orderkey % 29 = 0 then 'absent' else split_part(p_name, ' ', 1) end as keyword,
          cast(1440 + o_orderkey % 520 as int) as year,
          cast(1 + o_orderkey % 23 as int) as n_words
        from orders join part on p_partkey = o_orderkey % (select count(*) from part)""",
    "sense_items": """
        select vec_id as quote_id, concat('L', cast(label as varchar)) as lemma,
          concat('L', cast(label as varchar), '+', cast(vec_id % 3 as varchar)) as sense,
          cast(1450 + (vec_id * 7) % 500 as int) as year, embedding
        from embeddings""",
    "pairs": """
        select a.o_orderkey as pair_id, concat('s', cast(a.o_orderkey as varchar)) as s1,
          concat('s', cast(b.o_orderkey as varchar)) as s2,
          cast(1451 + (a.o_orderkey * 31) % 498 as int) as y1,
          cast(1451 + (b.o_orderkey * 31) % 498 as int) as y2
        from orders a join orders b on b.o_orderkey = a.o_orderkey + 1""",
    "dating_items": f"""
        select vec_id as item_id, cast(1450 + (vec_id * 13) % 500 as int) as item_year
        from embeddings where md5(concat_ws(':', 'bgpart', cast(vec_id as varchar))) >= '{BG_PART}'""",
    "background_pool": f"""
        select bg_id, bg_year from (
          select vec_id as bg_id, cast(1450 + 10 * (vec_id % 50) as int) as bg_year,
            row_number() over (partition by 1450 + 10 * (vec_id % 50)
              order by md5(concat_ws(':', 'bg', cast(vec_id as varchar))), vec_id) as rn
          from embeddings where md5(concat_ws(':', 'bgpart', cast(vec_id as varchar))) < '{BG_PART}')
        where rn <= {BG_PER_DECADE}""",
    "scored_items": """
        select vec_id as item_id, cast(1450 + (vec_id * 13) % 500 as int) as item_year from embeddings""",
    "drawn_pool": f"""
        select bg_id, bg_year from (
          select vec_id as bg_id, cast(1450 + 10 * (vec_id % 50) as int) as bg_year,
            row_number() over (partition by 1450 + 10 * (vec_id % 50)
              order by md5(concat_ws(':', 'bg', cast(vec_id as varchar))), vec_id) as rn
          from embeddings)
        where rn <= {BG_PER_DECADE}""",
    "scores": """
        select item_id, bg_id, item_year, bg_year,
          case when item_year > bg_year then 0.5::double + 0.5::double * u else 0.6::double * u end as score
        from (select i.item_id, g.bg_id, i.item_year, g.bg_year,
          ('0x' || substr(md5(concat_ws(':', 'sc', cast(i.item_id as varchar), cast(g.bg_id as varchar))), 1, 15))::bigint
            / 1152921504606846976.0::double as u
          from scored_items i cross join drawn_pool g)""",
    "tagged": """
        select doc_id as sent_id, source, tokens,
          list_transform(tokens, lambda x: concat('T', cast(length(x) % 5 as varchar))) as tags,
          list_transform(tokens, lambda x: case when md5(concat(cast(doc_id as varchar), x)) < '33' then 'T0'
            else concat('T', cast(length(x) % 5 as varchar)) end) as preds
        from (select doc_id, source,
                list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda x: length(x) > 0) as tokens
              from documents)""",
    "candidates": """
        select quote_id, keyword as kw, list_transform(range(0, 5), lambda i: {
            'token_str': words[((quote_id * 5 + i * 3) % len(words))::int + 1],
            'score': 1.0::double / (i + 2)}) as candidates
        from quotes cross join (select list(w order by w) as words from (
          select distinct unnest(string_split(p_name, ' ')) as w from part))""",
}

# Which fixtures each fixture needs first (for CTE assembly).
_DEPS = {"scores": ["scored_items", "drawn_pool"], "candidates": ["quotes"]}


def duck_with(*names: str) -> str:
    """A WITH clause defining the named fixtures (and what they depend on) for DuckDB."""
    ordered: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({DUCK[n]})" for n in ordered) + "\n"
