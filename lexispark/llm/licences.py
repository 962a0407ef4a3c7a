r"""License scans by a positional rare-token index (DataFrame functions only).

Templates are word sequences with a label and mandatory key phrases.  Document frequencies of the
template words are counted over all files; the rarest words of each template (highest IDF) make
postings (word -> template, offset).  A file looks up those of its words that are posted: an occurrence
puts the start of a template at ``position - offset``.  The lists of starts are intersected: a
start remains where all posted words of the template agree on it (two, or the one of a template of one
word).  A place is accepted when the template's mandatory phrases stand there word for word and enough
IDF weight of its words is in place.

Everything happens inside the row, so there is no shuffle of text and no hot key.

Defined cases: null text is empty; no words give n_words 0, no labels and score 0; every place of
a phrase counts, overlapping ones too; repeated rows are scanned one by one; input columns named
like output columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, let

#: What separates words once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str                    # the words, with single spaces
    keys: tuple[str, ...] = ()   # phrases within ``text`` that must stand there; none: all of it
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    def mandatory(self) -> list[tuple[int, list[str]]]:
        """(offset, words) of each key phrase."""
        out = []
        for key in self.keys or (self.text,):
            k = key.split(" ")
            out.append((next(i for i in range(len(self.words)) if self.words[i:i + len(k)] == k), k))
        return out


BASE = (Template("mit", "under the mit license", base=True),
        Template("apache-2", "apache license version 2", base=True),
        Template("cc-by-nc", "cc by nc", base=True))
#: Well-known sentences of public licences.
OWN = (
    Template("gpl", "gnu general public license"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of "
             "this software and associated documentation files",
             ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification "
             "are permitted", ("redistribution and use in source and binary forms",)),
    Template("apache-2", "licensed under the apache license version 2",
             ("apache license version 2",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify and or distribute this software",)),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)
TEMPLATES = BASE + OWN


def licence_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                      "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BREAK), "")


def word_idf(df: DataFrame, templates: Sequence[Template], text: str = "text") -> dict[str, float]:
    """IDF over all files of each template word: as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    hits = F.array_intersect(F.array(*map(F.lit, vocabulary)), licence_words(F.col(text)))
    rows = (df.select(F.explode(F.array_append(hits, F.lit(""))).alias("w")).groupBy("w").count()
            .collect())  # at most len(vocabulary) + 1 rows; "" counts the files
    n = {r["w"]: r["count"] for r in rows}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 1.0 for w in vocabulary}


def rare_offsets(template: Template, idf: dict[str, float], rare: int) -> list[int]:
    """Offsets of the ``rare`` rarest words of its mandatory phrases (ties: first in the text)."""
    inside = sorted({at + i for at, k in template.mandatory() for i in range(len(k))})
    return sorted(inside, key=lambda i: (-idf[template.words[i]], i))[:rare]


def _literal_words(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def scan_licences(df: DataFrame, templates: Sequence[Template] = TEMPLATES, *, rare: int = 2,
                  accept: float = 0.8, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and places
    (label, template number, start, coverage of every accepted place)."""
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
               "places")
    idf = word_idf(df, templates, text)
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        for at in rare_offsets(template, idf, rare):
            postings.setdefault(template.words[at], []).append((number, at))
    tokens = sorted(postings)
    token_list = _literal_words(tokens)
    lists = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o"))
                                for t, o in postings[w]]) for w in tokens])

    def starts(w):
        """The (template, start) on which all posted words of the template agree.  Occurrences of a word
        give different starts, so a start that k words agree on is there k times in a row when sorted."""
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1),
                      lambda i: F.array_contains(token_list, w[i]))
        told = F.sort_array(F.flatten(F.transform(at, lambda i: F.transform(
            lists[F.array_position(token_list, w[i]).cast("int") - 1],
            lambda p: F.struct(p["t"].alias("t"), (i - p["o"]).alias("start"))))))
        need = F.array(*[F.lit(len(rare_offsets(t, idf, rare))) for t in templates])
        return let(told, lambda v: F.transform(F.filter(
            F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
            lambda e: (F.get(v, e["i"] + F.get(need, e["x"]["t"]) - 1) == e["x"])
            & ((e["i"] == 0) | ~F.get(v, e["i"] - 1).eqNullSafe(e["x"]))), lambda e: e["x"]))

    def stands(w, start, phrase_at, phrase):
        """The phrase stands at start + phrase_at (an index outside the text is null)."""
        ok = F.lit(True)
        for i, x in enumerate(phrase):
            at = start + (phrase_at + i)
            ok = ok & (at >= 0) & (at < F.size(w)) & F.coalesce(
                F.get(w, at) == F.lit(x), F.lit(False))
        return ok

    def coverage(w, start, template):
        """IDF weight of the words in place, as a share; 0 unless the key phrases stand."""
        total = sum(idf[x] for x in template.words)
        part = F.lit(0.0)
        for i, x in enumerate(template.words):
            part = part + F.when(F.get(w, F.greatest(start + i, F.lit(0))) == F.lit(x),
                                 F.lit(idf[x] / total)).otherwise(0.0)
        ok = F.lit(True)
        for at, phrase in template.mandatory():
            ok = ok & stands(w, start, at, phrase)
        if not template.keys:  # the whole template is mandatory
            return F.when(ok, F.lit(1.0)).otherwise(0.0)
        return F.when(ok, F.least(F.lit(1.0), F.round(part, 9))).otherwise(0.0)

    def places(w):
        def check(v):
            score, label = F.lit(0.0), F.lit("")
            for number, template in enumerate(templates):
                here = v["t"] == number
                score = F.when(here, coverage(w, v["start"], template)).otherwise(score)
                label = F.when(here, F.lit(template.label)).otherwise(label)
            return F.struct(label.alias("label"), v["t"].alias("template"),
                            v["start"].alias("start"), score.alias("coverage"))
        none = F.filter(F.array(F.struct(
            F.lit("").alias("label"), F.lit(0).alias("template"), F.lit(0).alias("start"),
            F.lit(0.0).alias("coverage"))), lambda x: x["start"] > 0)
        found = F.filter(F.transform(starts(w), check), lambda x: x["coverage"] >= accept)
        return F.when(F.arrays_overlap(w, token_list), found).otherwise(none)

    kept = [c for c in df.columns if c not in outputs or c == text]
    both, n, p = fresh("scan"), fresh("n"), fresh("places")
    base = F.filter(p, lambda x: x["template"].isin(
        [i for i, t in enumerate(templates) if t.base] or [-1]))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(
        F.transform(c, lambda x: x["label"]))), ",")
    return (df.select(*kept)
            .withColumn(both, let(licence_words(F.col(text)), lambda w: F.struct(
                F.size(w).cast("bigint").alias("n"), places(w).alias("p"))))
            .withColumn(n, F.col(f"{both}.n")).withColumn(p, F.col(f"{both}.p"))
            .select(*[c for c in kept if c not in outputs], F.col(n).alias("n_words"),
                    F.size(base).cast("bigint").alias("n_base"),
                    F.array_min(F.transform(base, lambda x: x["start"])).cast("bigint")
                    .alias("first_word"),
                    F.array_max(F.transform(base, lambda x: x["start"])).cast("bigint")
                    .alias("last_word"),
                    joined(base).alias("base_labels"), joined(F.col(p)).alias("labels"),
                    F.coalesce(F.array_max(F.transform(p, lambda x: x["coverage"])), F.lit(0.0))
                    .alias("score"), F.col(p).alias("places")))


def _phrase_sql(words: Sequence[str], at: int = 0) -> str:
    return " and ".join(f"w[i + {at + k}] = '{x}'" for k, x in enumerate(words))


def licence_sql(templates: Sequence[Template] = TEMPLATES, accept: float = 0.8) -> str:
    """The same by a plain scan of every position for every template: its key phrases word for word,
    and the IDF weight of its words in place."""
    vocabulary = sorted({x for t in templates for x in t.words})

    def branch(number: int, t: Template) -> str:
        keys = " and ".join(f"({_phrase_sql(k, at)})" for at, k in t.mandatory())
        share = "1.0::double"
        if t.keys:
            weight = lambda x: f"idf['{x}']"
            held = " + ".join(f"case when w[i + {k}] = '{x}' then {weight(x)} else 0 end" for k, x in enumerate(t.words))
            share = f"least(1.0, round(({held}) / ({' + '.join(map(weight, t.words))}), 9))"
        return (f"select doc_id, i - 1 as start, '{t.label}' as label, {str(t.base).lower()} as base, {share} as share "
                f"from spots, weights where {keys}")
    branches = "\nunion all ".join(branch(i, t) for i, t in enumerate(templates))
    return rf"""
with toks as materialized (
  select doc_id, [x for x in regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents),
files as (select count(*) as n from toks),
weights as materialized (select map_from_entries(list((v.x, ln((1 + files.n) / (1 + coalesce(c.n, 0))) + 1.0))) as idf
  from (select unnest({vocabulary}) as x) v cross join files left join (
    select x, count(*) as n from (select unnest(list_distinct(w)) as x from toks) group by x) c on c.x = v.x),
spots as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from toks),
hits as materialized (select * from ({branches}) where share >= {accept}),
per_doc as (
  select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word,
    max(start) filter (base) as last_word, max(share) as score,
    coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
    string_agg(distinct label, ',' order by label) as labels
  from hits group by doc_id)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
  first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from toks t left join per_doc using (doc_id)
"""
