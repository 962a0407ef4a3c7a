"""String expressions over quotations (JVM built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.arrays import let

# Part-of-speech tags kept by default, stop lemmas, and the target marker.
KEEP_POS = ["n", "adj", "v"]
STOP_LEMMAS = ["the", "much"]
TARGET_MARK = "[TGT]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python-style strip(): leading/trailing whitespace of any kind (trim only does spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def first_pos(word) -> Column:
    """First part of speech of a 'headword, pos.' entry.

    Second comma field; 'and', '(' and ')' deleted; stripped; its first whitespace token
    when it holds a space; the text before the first '.'.  No comma gives NULL.
    """
    p = F.get(F.split(_c(word), ","), 1)
    p = F.replace(F.replace(F.replace(p, F.lit("and"), F.lit("")), F.lit("("), F.lit("")),
                  F.lit(")"), F.lit(""))
    p = py_strip(p)
    tok = F.when(F.instr(p, " ") > 0, F.regexp_extract(p, r"^\S+", 0)).otherwise(p)
    return F.substring_index(tok, ".", 1)


def sense_parts(numbering) -> Column:
    return F.split(F.regexp_replace(_c(numbering), r"\.+$", ""), r"\.")


def sense_depth(numbering) -> Column:
    """Number of '.'-separated parts once trailing dots are removed ('' counts 1)."""
    return F.size(sense_parts(numbering))


def depth_key(numbering, depth, joiner: str = ".") -> Column:
    """Sense path cut at ``depth`` parts, joined by ``joiner`` (shorter paths kept whole)."""
    d = F.lit(depth) if isinstance(depth, int) else _c(depth)
    return F.array_join(F.slice(sense_parts(numbering), F.lit(1), d), joiner)


def year_bin(year, span: int) -> Column:
    """span * floor(year / span) (floor division, right for negative years too)."""
    return (F.floor(_c(year) / F.lit(span)) * F.lit(span)).cast("int")


def qualify(lemma, sense, sep: str = "+") -> Column:
    """lemma+sense; NULL if either is NULL (concat, not concat_ws, which skips NULLs)."""
    return F.concat(_c(lemma), F.lit(sep), _c(sense))


def keyword_pattern(keyword) -> Column:
    """Regex matching the keyword's words (quoted) separated by any whitespace."""
    words = F.split(py_strip(keyword), r"\s+")
    quoted = lambda w: F.concat(
        F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    return F.array_join(F.transform(words, quoted), r"\s+")


def keyword_span(quote, keyword) -> Column:
    """struct(start, end) half-open char offsets of the first whole-token occurrence of the
    keyword in the quote; NULL if absent.

    Tokens are runs of Unicode word characters or single other non-space characters, so a
    keyword matches when it is not glued to a word character on either side.  One regex pass: the
    quote is cut in two at the first match.
    """
    pat = F.concat(F.lit(r"(?U)(?<!\w)"), keyword_pattern(keyword), F.lit(r"(?!\w)"))
    return let(F.split(_c(quote), pat, 2), lambda cut: F.when(F.size(cut) == 2, F.struct(
        F.length(F.get(cut, 0)).alias("start"),
        (F.length(_c(quote)) - F.length(F.get(cut, 1))).alias("end"))))


def subtoken_span(offsets, start, end) -> Column:
    """struct(first, last) half-open sub-token indices of the character span [start, end): the last
    sub-token that begins at ``start`` and the one that ends at ``end``.  NULL where no sub-token
    does.  ``offsets`` is an array of (start, end); sub-tokens without characters are ignored."""
    at = lambda x, side, place: F.array_max(F.filter(F.transform(x["o"], lambda y, i: F.when(
        (y["start"] < y["end"]) & (y[side] == x[place]), i)), lambda i: i.isNotNull()))
    found = let(F.struct(_c(offsets).alias("o"), _c(start).alias("s"), _c(end).alias("e")), lambda x: F.struct(
        at(x, "start", "s").alias("first"), (at(x, "end", "e") + 1).alias("last")))
    return let(found, lambda x: F.when(x["first"].isNotNull() & x["last"].isNotNull(), x))


def mask_first(quote, keyword, mask: str = "[MASK]") -> Column:
    """Replace only the first occurrence of the keyword (instr + overlay); unchanged if absent."""
    pos = F.instr(_c(quote), _c(keyword))
    return F.when(pos > 0, F.overlay(_c(quote), F.lit(mask), pos, F.length(_c(keyword)))) \
        .otherwise(_c(quote))


def mark_keyword(quote, keyword, sym: str = TARGET_MARK) -> Column:
    """q[:pos] + 'SYM k SYM' + q[pos+len:] at the first occurrence; NULL if absent."""
    pos = F.instr(_c(quote), _c(keyword))
    marked = F.concat(F.lit(sym + " "), _c(keyword), F.lit(" " + sym))
    return F.when(pos > 0, F.overlay(_c(quote), marked, pos, F.length(_c(keyword))))


def mark_span(quote, start, end, sym: str = TARGET_MARK) -> Column:
    """Insert 'SYM ' before and ' SYM' after the half-open span [start, end)."""
    q, s, e = _c(quote), _c(start), _c(end)
    return F.concat(F.substring(q, 1, s), F.lit(sym + " "), F.substring(q, s + 1, e - s),
                    F.lit(" " + sym), F.substring(q, e + 1, 1 << 30))
