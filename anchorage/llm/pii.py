"""Personal data: base patterns, and bootstrapped contextual extraction over the corpus, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import ascii_lower, sha256_hex

#: Kinds in the order in which spans are listed, with the Java pattern of each. A look-behind keeps a failing run from being
#: tried again from each of its characters, and possessive runs from being given back: the matches are the same, in linear time.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Matches of a text that are placed at a time.
STRETCH = 128
#: What a text must hold for a kind to be looked for at all, as a pattern.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Tokens that may identify somebody: with a digit or @, and the groups of digits that follow one.
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9().-]++(?!\S))*+"


def paired(found: Column, gaps: Column) -> Column:
    """Each match of a text with the length of what lies before it; found and gaps: all that a pattern extracts, and what it splits off."""
    return F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda s, g: F.struct(s.alias("s"), F.length(g).alias("g")))


def located(pairs: Column) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches, from paired(); code points, end exclusive.

    What lies between the matches is split off by the same pattern, so the lengths of both give the places. pairs should
    be a column of its own, as lambdas work out an expression anew wherever it stands.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("out"))

    # Arrays grow by copies, so places are found within stretches of matches first, and then those of the stretches.
    last = F.greatest(F.ceil(F.size(pairs) / STRETCH).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(pairs, i * STRETCH + 1, F.lit(STRETCH)), zero, step))
    bases = F.aggregate(parts, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
    moved = F.zip_with(parts, F.slice(bases, 1, F.size(parts)), lambda c, b: F.transform(c["out"], lambda x: F.struct((x["start"] + b).alias("start"), (x["end"] + b).alias("end"), x["s"].alias("s"))))
    return F.when(F.size(pairs) <= STRETCH, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.flatten(moved))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    n = F.length(_digits(s))
    return {
        "email": F.lit(True),
        "ip": s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": (n >= 13) & (n <= 19) & luhn(_digits(s)),
        "phone": (n >= 9) & (n <= 15),
    }[kind]


def with_base(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with `base`, array<struct<kind, start, end, s>> by kind; [] for texts that cannot hold any."""
    text = F.col("text")
    may = {k: text.rlike(NEEDED[k]) for k in KINDS}
    none = F.array().cast("array<string>")
    out = docs.withColumns({f"__f_{k}": F.when(may[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in KINDS.items()})
    out = out.withColumns({f"__p_{k}": paired(F.col(f"__f_{k}"), F.when(F.size(f"__f_{k}") > 0, F.split(text, p, -1)).otherwise(none)) for k, p in KINDS.items()})
    spans = [F.transform(F.filter(located(F.col(f"__p_{k}")), _valid_of(k)), _of(k)) for k in KINDS]
    return out.withColumn("base", F.concat(*spans)).drop(*[f"__{c}_{k}" for c in "fp" for k in KINDS])


def _valid_of(kind: str):
    return lambda x: valid(kind, x["s"])


def _of(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by kind as listed, then start; comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(order[x["kind"]].alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mentions(marked: DataFrame) -> DataFrame:
    """One row for each identifier-like mention: (doc_id, text_hash, start, end, instance, context, kinds that the base gave it)."""
    text = F.col("text")
    at = marked.where(text.rlike("[0-9@]")).withColumns({"gaps": F.split(text, MENTION, -1), "found": F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))})
    at = at.withColumn("pairs", paired(F.col("found"), F.col("gaps"))).withColumn("found", located(F.col("pairs")))
    # The outer explode keeps the optimizer from looking for mentions once more to filter on them first.
    at = at.select("doc_id", "text_hash", "base", "gaps", F.posexplode_outer("found").alias("i", "m")).where("i is not null")
    before = F.element_at("gaps", F.col("i") + 1)
    left = ascii_lower(F.regexp_extract(before, r"(?<!\S)(\S++)\s*+$", 1))
    second = ascii_lower(F.regexp_extract(before, r"(?<!\S)(\S++)\s++\S++\s*+$", 1))
    right = ascii_lower(F.regexp_extract(F.element_at("gaps", F.col("i") + 2), r"^\s*+(\S++)", 1))
    tagged = lambda tag, word: F.when(F.length(word) > 0, F.concat(F.lit(tag), word))
    both = F.when((F.length(left) > 0) & (F.length(right) > 0), F.concat(F.lit("B:"), left, F.lit(" "), right))
    wide = F.when(F.length(second) > 0, F.concat(F.lit("W:"), second, F.lit(" "), left))
    inside = F.transform(F.filter("base", lambda b: (b["start"] < F.col("m.end")) & (b["end"] > F.col("m.start"))), lambda b: b["kind"])
    # The punctuation that closes a sentence is no part of an identifier.
    bare = F.regexp_replace("m.s", r"[.,;:!?\"')\]]+$", "")
    return at.select(
        "doc_id", "text_hash", F.col("m.start").alias("start"), (F.col("m.start") + F.length(bare)).alias("end"), bare.alias("instance"),
        F.array_compact(F.array(tagged("L:", left), tagged("R:", right), both, wide)).alias("contexts"), F.array_distinct(inside).alias("known"),
    ).where(F.length("instance") > 0)


def plausible(kind: Column, instance: Column) -> Column:
    """Whether an added span can be of the kind at all: an email has an @, the others none and a phone's 5 or a card's or address's 4 digits at least.

    What has just the form of a kind's base matches was looked at as such and rejected, so no context makes it one.
    """
    n = F.length(_digits(instance))
    rejected = {"ip": r"^[0-9]+(\.[0-9]+){3}$", "card": r"^[0-9]([\x20-]?[0-9])+$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
    again = F.lit(False)
    for k, form in rejected.items():
        again = again | ((kind == k) & instance.rlike(form))
    at = F.contains(instance, F.lit("@"))
    return ~again & F.when(kind == "email", at).otherwise(~at & (n >= F.when(kind == "phone", 5).otherwise(4)))


def bootstrap(scratch: Scratch, found: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.9) -> DataFrame:
    """found: mentions() -> (kind, pattern, confidence) of the patterns that are trusted in the end.

    A pattern is a whole word to the left or right of a mention, both together, or two to the left, whatever the mention's own form; what a
    kind can look like at all is asked of an added span (see plausible()). Patterns and instances make a
    bipartite graph for each kind, its edges counted over the whole corpus before anything iterates. Seeds, the instances
    that a base pattern found, start at 1 and stay there; a pattern's confidence is the mean over its distinct instances,
    0 with under `support` believed ones; an instance's is the best of its patterns. Each round carries belief one
    step further, so patterns can be reached through instances that no base pattern knows.
    """
    edges = found.select(F.explode("contexts").alias("word"), "instance", "known")
    edges = edges.select(F.xxhash64("word").alias("pattern"), F.xxhash64("instance").alias("instance"), "known")
    edges = edges.groupBy("pattern", "instance").agg(F.array_distinct(F.flatten(F.collect_set("known"))).alias("known"))
    edges = scratch.put(edges)
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    belief = edges.select("instance", F.explode("known").alias("kind")).distinct().withColumn("belief", F.lit(1.0))
    seeds = belief
    patterns = None
    for step in range(rounds):
        scored = edges.select("pattern", "instance").join(belief, "instance").groupBy("kind", "pattern").agg(F.sum("belief").alias("sum"))
        scored = scored.join(total, "pattern").where(F.col("sum") >= support).select("kind", "pattern", (F.col("sum") / F.col("n")).alias("confidence"))
        patterns = scratch.put(scored.where(F.col("confidence") >= 0.5))
        if step + 1 < rounds:
            reached = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
            belief = scratch.put(seeds.union(reached.select("instance", "kind", "belief")).groupBy("instance", "kind").agg(F.max("belief").alias("belief")))
    return patterns.where(F.col("confidence") >= confident)


def detect(docs: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.9) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans), one row for each row of docs.

    base_spans and spans are arrays of (kind, start, end): the base patterns' spans, and these with what bootstrapping adds
    (see bootstrap()); an added span overlaps no base span and has one kind, the most confident. n_* count base spans.
    Null and empty texts have none. Rows are told apart by doc_id and text, so repeated rows each get the same answer.
    Other columns are ignored. Only texts with a digit or @ take part in the graph, and only mentions are shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    marked = with_base(marked)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,s:string>>")
    found = scratch.put(mentions(marked))
    trusted = bootstrap(scratch, found, rounds, support, confident)
    new = found.where(F.size("known") == 0).select("doc_id", "text_hash", "start", "end", "instance", F.explode("contexts").alias("word"))
    new = new.withColumn("pattern", F.xxhash64("word")).join(trusted, "pattern").where(plausible(F.col("kind"), F.col("instance")))
    best = new.groupBy("doc_id", "text_hash", "start", "end").agg(F.max(F.struct("confidence", F.col("kind").alias("kind"))).alias("b"))
    # Only texts in which a span was found or added have a row here; the rest are all zeros.
    added = best.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "start", "end", F.lit("").alias("s"))).alias("more"))
    added = added.toDF("__id", "__hash", "more")
    bare = scratch.put(marked.select("doc_id", "text_hash", F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lit("").alias("s"))).alias("base")))
    out = bare.join(added, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    counts = [F.size(F.array_remove(F.col("base.kind"), k)) for k in KINDS]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts, strict=True)]
    return out.select("doc_id", *counts, F.col("base").alias("base_spans"), F.concat("base", F.coalesce("more", empty)).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    return detect(docs).select("doc_id", *[f"n_{k}" for k in KINDS], sha256_hex(listed(F.col("base_spans"))).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
