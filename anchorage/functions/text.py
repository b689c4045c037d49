"""Scalar text functions over columns: splitting, contexts, sub-phrases, casing, confidence and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jsplit(text: Column | str, pattern: str = " ") -> Column:
    """split() without empty strings at the end; one string, "", for an empty text."""
    text = _col(text)
    parts = F.split(F.regexp_replace(text, f"(?:{pattern})+$", ""), pattern, -1)
    return F.when(text == "", F.array(F.lit(""))).when(F.regexp_replace(text, pattern, "") == "", F.array().cast("array<string>")).otherwise(parts)


def word_count(text: Column | str) -> Column:
    return F.size(jsplit(text))


def clamp_slice(text: Column | str, start: Column, end: Column) -> Column:
    """Code points from start (negative: 0) to end, exclusive."""
    first = F.greatest(start, F.lit(0))
    return F.substring(_col(text), first + 1, F.greatest(end - first, F.lit(0)))


def resolved_offset(text: Column | str, name: Column | str, beg: Column | str) -> Column:
    """beg, or where the name first stands if beg is -1 or null; -1 if nowhere."""
    return F.when(F.coalesce(_col(beg), F.lit(-1)) == -1, F.expr("0") + F.instr(_col(text), _col(name)) - 1).otherwise(_col(beg))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "<[^>]*>", "")


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def char_context(text: Column | str, at: Column, width: int = 50) -> Column:
    """The words that lie whole within `width` code points on both sides of an offset."""
    words = F.split(clamp_slice(text, at - width, at + width), r"\s+", -1)
    return F.trim(strip_tags(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")))


def sentences(text: Column | str) -> Column:
    """A text cut behind . ! or ? where white space and no lower-case letter follow."""
    return F.split(_col(text), r"(?<=[.!?])\s+(?![a-z])", -1)


def sentence_with(text: Column, name: Column | str) -> Column:
    """The first sentence of a text that holds the name; null if none does."""
    return F.get(F.filter(sentences(text), lambda s: F.contains(s, _col(name))), F.lit(0))


def tag_bounded(text: Column | str, at: Column) -> Column:
    """The text between the last > before an offset and the first < from it on."""
    left = F.regexp_extract(clamp_slice(text, F.lit(0), at), r"([^>]*)$", 1)
    right = F.regexp_extract(F.substring(_col(text), at + 1, F.length(_col(text))), r"^([^<]*)", 1)
    return F.concat(left, right)


def paragraph_at(text: Column | str, at: Column) -> Column:
    """The paragraph, between <P> and </P>, that ends first behind an offset, without tags; null if none does."""
    ends = F.transform(F.split(_col(text), "</P>", -1), lambda p: p)
    walked = F.aggregate(
        ends, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("hit")),
        lambda a, p: F.struct((a["at"] + F.length(p) + 4).alias("at"), F.when(a["hit"].isNull() & (a["at"] + F.length(p) > at), p).otherwise(a["hit"]).alias("hit")),
        lambda a: a["hit"],
    )
    return F.when(F.contains(walked, F.lit("<P>")), strip_tags(F.regexp_extract(walked, r"(?s)<P>((?:(?!<P>).)*)$", 1)))


def context(text: Column | str, name: Column | str, beg: Column | str) -> Column:
    """Sentence of the enclosing paragraph, else of the tag-bounded text, else the words round the offset."""
    at = resolved_offset(text, name, beg)
    return squeeze(F.coalesce(sentence_with(paragraph_at(text, at), name), sentence_with(tag_bounded(text, at), name), char_context(text, at)))


def wide_context(text: Column | str, name: Column | str, beg: Column | str) -> Column:
    return squeeze(tag_bounded(text, resolved_offset(text, name, beg)))


def headline_contexts(text: Column | str) -> Column:
    """[first paragraph without tags, headline], each if there is one; white space squeezed, hyphens as spaces."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "-", " "))
    part = lambda p: F.nullif(F.regexp_extract(_col(text), p, 1), F.lit(""))
    found = F.array_compact(F.array(part(r"(?s)<P>([^<]+)</P>"), part(r"(?s)<HEADLINE>([^<]+)</HEADLINE>")))
    return F.transform(found, lambda x: squeeze(clean(x)))


def mention_contexts(contexts: Column, headline: Column) -> Column:
    """Distinct contexts of all mentions, with headline items that none of them holds before them."""
    own = F.array_distinct(contexts)
    return F.concat(F.filter(headline, lambda h: ~F.exists(own, lambda c: F.contains(c, h))), own)


def occurrences(text: Column | str, part: Column | str) -> Column:
    """Offsets of all occurrences, overlapping ones too; an empty part is at every offset.

    The text is cut before each occurrence, in one pass, and offsets are the lengths of the pieces added up.
    """
    t, p = _col(text), _col(part)
    before = F.concat(F.lit(r"(?=\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    lengths = F.transform(F.split(t, before, -1), F.length)
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("all"))
    ends = F.aggregate(F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")))
    places = F.concat(F.when(F.startswith(t, p), F.array(F.lit(0))).otherwise(none), ends["all"])
    return F.when(p == "", F.sequence(F.lit(0), F.length(t))).when(F.contains(t, p), places).otherwise(none)


def backoff_strings(name: Column | str, entity: Column | str) -> Column:
    """Contiguous sub-phrases of entity with more words than name that hold it, the last start and shortest first."""
    n, words = _col(name), jsplit(entity)
    size = F.size(words)
    starts = F.sequence(size, F.lit(1), F.lit(-1))
    phrases = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.slice(words, i, k))))
    longer = F.filter(phrases, lambda w: (F.size(w) > F.size(jsplit(n))) & F.contains(F.array_join(w, " "), n))
    return F.transform(longer, lambda w: F.array_join(w, " "))


def confidence(score: Column | str, threshold: float = 0.93) -> Column:
    """0.55 up to the threshold; above it from 0.80 to 1 by whole hundredths over it."""
    s = _col(score)
    over = F.when(s >= 0, F.floor(100 * s - 100 * threshold)).cast("double")
    return F.when(s > threshold, (over * (20 / ((1 - threshold) * 100)) + 80) / 100).otherwise(F.lit(0.55))


def location_casing(text: Column | str) -> Column:
    """Each space-parted word without a full stop lower-cased with a capital first letter; a letter whose capital is
    several letters (the sharp s) stays as it is."""

    def case(w: Column) -> Column:
        low = F.lower(w)
        first = F.substring(low, 1, 1)
        big = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
        return F.when(F.contains(w, F.lit(".")), w).otherwise(F.concat(big, F.substring(low, 2, F.length(low))))

    return F.array_join(F.transform(F.split(_col(text), " ", -1), case), " ")


def abbreviation(name: Column | str) -> Column:
    """First letters of the words, upper-cased."""
    return F.array_join(F.transform(F.split(_col(name), r"\s+", -1), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def without_parentheses(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(title), r"\([^\(]+\)", ""))


def trimmed_context(context: Column | str, name: Column | str, side: int = 40) -> Column:
    """`side` code points round the name, or the middle of the context where it does not hold it."""
    c, n = _col(context), _col(name)
    at, mid = F.instr(c, n) - 1, F.floor(F.length(c) / 2).cast("int")
    return F.when(at >= 0, clamp_slice(c, at - side, at + F.length(n) + side)).otherwise(clamp_slice(c, mid - side, mid + side))


def first_paragraphs(text: Column | str, least: int = 7, until: int = 1500) -> Column:
    """Paragraphs but the first, of over `least` words, up to the one that brings the words to `until`."""
    rest = F.filter(F.slice(F.split(_col(text), "\n\n", -1), 2, 1 << 20), lambda p: F.size(F.split(p, r"\s+", -1)) > least)
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    step = lambda a, p: F.when(a["n"] >= until, a).otherwise(F.struct((a["n"] + F.size(F.split(p, r"\s+", -1))).alias("n"), F.concat(a["out"], F.array(p)).alias("out")))
    return F.aggregate(rest, zero, step, lambda a: F.array_join(a["out"], " "))


def intro(text: Column | str, chars: int = 100) -> Column:
    """First sentence of a text, or its first `chars` code points where it has no end of sentence."""
    t = _col(text)
    return F.when(t.rlike(r"[.!?](\s|$)"), F.get(sentences(t), F.lit(0))).otherwise(F.left(t, F.lit(chars)))


def two_decimals(x: Column | str) -> Column:
    return F.format_string("%1.2f", _col(x))
