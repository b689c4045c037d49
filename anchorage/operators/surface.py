"""The fullest name of a mention within its document, by the type of entity it seems to be."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import STOP_WORDS
from .gazetteer import STATES
from .occurrences import Spans, found


@dataclass
class Gazetteer:
    """Lower-cased place names by kind, and cities by container, in the gazetteer's case. Of bounded size: one row for each named place of the world at most."""

    cities: frozenset = frozenset()
    states: frozenset = frozenset()
    countries: frozenset = frozenset()
    within: dict[str, frozenset] = field(default_factory=dict)

    def kinds(self, name: str) -> set[str]:
        n = name.lower()
        return {k for k, s in (("city", self.cities), ("state", self.states), ("country", self.countries)) if n in s}

    def contains(self, container: str, city: str) -> bool:
        return city in self.within.get(container, ())


@dataclass
class Mention:
    name: str
    text: str
    beg: int
    ner_type: str = "None"
    orgs: list[str] = field(default_factory=list)
    locs: list[str] = field(default_factory=list)
    people: list[str] = field(default_factory=list)
    matching: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    sports: bool | None = None


def by_proximity(m: Mention, strings: list[str]) -> list[str]:
    """Distinct strings, the one that last stands before the mention first; those that never do come last, by text."""

    def distance(s: str) -> int:
        at = m.text.rfind(s, 0, max(m.beg - 1 + len(s), 0)) if s else -1
        return m.beg - at if 0 <= at < m.beg else len(m.text)

    return sorted(dict.fromkeys(strings), key=lambda s: (distance(s), s))


def _longer_phrase(name: str, strings: list[str], below: int | None = None) -> str | None:
    """The first string that has the name as its first or last words and more words besides."""
    own = name.split(" ")
    for s in strings:
        w = s.split(" ")
        if len(w) > len(own) and own in (w[-len(own) :], w[: len(own)]) and (below is None or len(w) < below):
            return s
    return None


def organization(m: Mention) -> str:
    """Expansion of an acronym by initials, or by what stands before it in the text; a longer phrase; a longer word."""
    name, near = m.name.strip(), by_proximity(m, m.orgs)
    if not name:
        return m.name
    if name.isupper() or re.search(r"\([^()]{0,15}" + re.escape(name) + r"[^()]{0,15}\)", m.text):
        for s in near:
            capital = [w for w in s.split(" ") if w[:1].isupper()][-len(name) :]
            if [w[0] for w in capital] == list(name):
                words = s.split(" ")
                return " ".join(words[words.index(capital[0]) :])
        ends = re.escape(name[0].upper() + name[-1].upper())
        if found := re.search(rf"([{ends}]\S+ (?:\S+ ){{0,2}}[A-Z]\S+).{{0,15}}{re.escape(name)}", m.text):
            first, _, rest = found[1].partition(" ")
            return rest if first.lower() in STOP_WORDS else found[1]
    if (m.sports or not any(name in x for x in m.locs)) and (longer := _longer_phrase(name, m.orgs)):
        return longer
    return next((s for s in near if " " not in s and len(s) > len(name) and s.lower().startswith(name.lower())), name)


def _cased(text: str) -> str:
    return " ".join(w if "." in w else w[:1].upper() + w[1:].lower() for w in text.split(" "))


def _expanded(text: str, gaz: Gazetteer) -> str:
    """'City, St.' with the state in full, where the gazetteer has the city there."""
    if found := re.search(r"(\w+),\s([A-Za-z])\.?([A-Za-z])\.?$", text):
        state = STATES.get((found[2] + found[3]).upper())
        return f"{found[1]}, {state}" if state and gaz.contains(state, found[1]) else text
    if (found := re.search(r"^(.*), (\w{3,})\.$", text)) and (full := sorted(s for s in STATES.values() if s.startswith(found[2]))):
        return f"{found[1]}, {full[0]}"
    return text


def _valid_place(text: str, gaz: Gazetteer) -> bool:
    parts = [p.strip() for p in text.split(",")]
    return len(parts) == 2 and (gaz.contains(parts[1], parts[0]) or not gaz.kinds(parts[0]) & gaz.kinds(parts[1]))


def location(m: Mention, gaz: Gazetteer, rarest: bool = True) -> str:
    """'Name, Container' from a longer location, from a container among the document's locations, or from the text itself."""
    name, near = m.name.strip(), by_proximity(m, m.locs)
    own = name.lower().split(" ")
    found = []
    for s in near:
        w = s.split(" ")
        for i in range(len(w) - len(own) - 1):
            if [x.lower() for x in w[i : i + len(own)]] == own and w[i + len(own)] in (",", "in"):
                found.append(" ".join(w[i : i + len(own)]) + ", " + " ".join(w[i + len(own) + 1 :]))
    found = [x for x in found if len(x.split(" ")) < 7 and _valid_place(x, gaz)]
    if found:
        return _expanded(_cased(found[0]), gaz)
    if held := [s for s in near if s not in (name, "United States") and gaz.contains(s, name)]:
        return _cased(f"{name}, {held[0]}")
    quoted = "|".join(re.escape(x) for x in (name, name.lower(), name.upper()))
    votes: dict[str, int] = {}
    for x in re.finditer(rf"({quoted}),\s?([A-Z]\S+)[\s.?!,]", m.text) if name else ():
        place, _, container = _expanded(_cased(f"{x[1]}, {x[2]}"), gaz).partition(",")
        if gaz.contains(container.strip(), place.strip()):
            votes[container.strip()] = votes.get(container.strip(), 0) + 1
    if votes:
        return f"{name}, {min(votes, key=lambda k: (votes[k] if rarest else -votes[k], k))}"
    return name


def person(m: Mention, likely: bool) -> str:
    """A longer name of at most three words; if a person is likely, one that stands alone in the text."""
    name = m.name.strip()
    if longer := _longer_phrase(name, by_proximity(m, m.people), below=4):
        return longer
    if likely:
        alone = [x[1] for x in re.finditer(r"(?:\.|\s[a-z]+\s)([A-Z]\w+\s[A-Z]\w+)(?=\.|\s[a-z]+\s)", m.text) if name in x[1]]
        if alone:
            return by_proximity(m, alone)[0]
    return name


def coreferent(m: Mention, longest_span: int = 50) -> str:
    """The shortest entity without a comma, longer than the name, that stands within a mention of the same chain."""
    pool = {"ORGANIZATION": m.orgs, "LOCATION": m.locs, "PERSON": m.people}.get(m.ner_type, [*m.orgs, *m.locs, *m.people])
    spans = Spans((a, b) for a, b in m.spans if b - a + 1 < longest_span)
    fits = [s for s in dict.fromkeys([*pool, *m.matching]) if len(s) > len(m.name) and "," not in s]
    inside = {s for s, at in found(m.text, fits) if spans.hold(at, at + len(s) - 1)} if fits else ()
    return min(inside, key=lambda s: (len(s), s), default=m.name)


def best_string(m: Mention, gaz: Gazetteer, rarest: bool = True) -> str:
    """What the mention's type suggests; if that is the name itself, what the other types do; at last what its chain does."""
    place = m.sports is not True
    typed = {"ORGANIZATION": lambda: organization(m), "LOCATION": lambda: location(m, gaz, rarest) if place else m.name, "PERSON": lambda: person(m, True), "None": lambda: m.name}
    if m.ner_type not in typed:
        raise ValueError(f"unknown entity type {m.ner_type}")
    steps = [typed[m.ner_type], lambda: organization(m), lambda: location(m, gaz, rarest) if place else m.name, lambda: person(m, False)]
    for step in steps:
        if (s := step()) != m.name:
            return s
    s = coreferent(m)
    return s if m.name.lower() in s.lower() else m.name


def entity_strings(mentions: DataFrame, gaz: Gazetteer, rarest: bool = True) -> DataFrame:
    """mentions(name, text, beg, ner_type, orgs, locs, people, matching, spans, sports, ...) -> with entity and error_reason.

    A mention without annotations or of an unknown type keeps its name and says so in error_reason. Row by row over Arrow
    batches: the rules hang on each other's results and on patterns made from the name.
    """

    @F.pandas_udf("string")
    def best(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.itertuples():
            lists = {k: list(v) if (v := getattr(r, k)) is not None else [] for k in ("orgs", "locs", "people", "matching")}
            spans = [(x["start"], x["end"]) for x in (r.spans if r.spans is not None else [])]
            sports = None if r.sports is None or pd.isna(r.sports) else bool(r.sports)
            out.append(best_string(Mention(r.name or "", r.text or "", int(r.beg), r.ner_type, spans=spans, sports=sports, **lists), gaz, rarest))
        return pd.Series(out, dtype=object)

    bad = F.when(F.col("ner_type").isNull(), "no annotation").when(~F.col("ner_type").isin("ORGANIZATION", "LOCATION", "PERSON", "None"), "unknown entity type")
    fields = F.struct("name", "text", F.coalesce("beg", F.lit(-1)).alias("beg"), F.when(bad.isNull(), F.col("ner_type")).otherwise("None").alias("ner_type"), "orgs", "locs", "people", "matching", "spans", "sports")
    return mentions.withColumn("error_reason", bad).withColumn("entity", F.when(bad.isNull(), best(fields)).otherwise(F.col("name")))
