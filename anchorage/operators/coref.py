"""Chains of the entities of a document that go by one name: the same words, a part of a longer name, or its initials."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import annotations

_ACRONYM, _CAPITAL = re.compile("[A-Z]{2,}"), re.compile("[A-Z]")
Found = tuple[str, tuple, str]


def chain_ends(found: Iterable[Found]) -> dict[tuple[str, str], str]:
    """Entities of one document as (type, place, entity) -> for each (type, name in lower case) the name that its chain leads to.

    A name leads to the first longer name of its type whose first or last words these are; for an organization of capital letters alone
    that has none, to the first whose capital words have these initials. A name's parent has more words, so links run in no circle.
    """
    first: dict[tuple[str, str], tuple[tuple, str]] = {}
    for kind, at, entity in found:
        key = kind, entity.lower()
        if key not in first or (at, entity) < first[key]:
            first[key] = at, entity
    order = sorted(first, key=lambda k: (first[k][0], k[1]))
    parent: dict[tuple[str, str], str] = {}
    longer: dict[str, str] = {}
    for kind, name in order:
        words = name.split(" ")
        for i in range(1, len(words)):
            for part in ((kind, " ".join(words[:i])), (kind, " ".join(words[-i:]))):
                if part in first:
                    parent.setdefault(part, name)
        if kind == "ORGANIZATION" and len(words) > 1:
            initials = [w[0] for w in first[kind, name][1].split(" ") if _CAPITAL.match(w)]
            if len(initials) > 1:
                longer.setdefault("".join(initials), name)
    for key in order:
        entity = first[key][1]
        if key not in parent and key[0] == "ORGANIZATION" and _ACRONYM.fullmatch(entity) and entity in longer:
            parent[key] = longer[entity]
    ends = {}
    for kind, name in order:
        end = name
        while (kind, end) in parent:
            end = parent[kind, end]
        ends[kind, name] = end
    return ends


def chains(entities: DataFrame) -> DataFrame:
    """entities(doc_id, sent, first, type, entity, ...) with `chain`: the name that all others of the chain lead to, by chain_ends(). A document's entities are made one row first.

    Null and empty names are left out.
    """
    known = entities.where("entity <> '' and doc_id is not null and type is not null")
    one = known.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in entities.columns if c != "doc_id"])).alias("e"))
    schema = T.StructType([*one.schema.fields, T.StructField("chain", T.ArrayType(T.StringType()))])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, annotations.SLICE):
                part = batch.slice(lo, annotations.SLICE)
                made = []
                for own in part.column(1):
                    sent, first, kinds, names = (own.values.field(c).to_pylist() for c in ("sent", "first", "type", "entity"))
                    places = [(s is not None, s, i is not None, i) for s, i in zip(sent, first, strict=True)]
                    ends = chain_ends(zip(kinds, places, names, strict=True))
                    made.append([ends[k, n.lower()] for k, n in zip(kinds, names, strict=True)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.string()))], names=["doc_id", "e", "chain"])

    out = one.mapInArrow(take, schema).select("doc_id", F.explode(F.arrays_zip("e", "chain")).alias("x"))
    return out.select("doc_id", "x.e.*", "x.chain").select(*entities.columns, "chain")


def chain_counts(docs: DataFrame, key: str, texts: str, tokens: Callable[[str], annotations.Tokens]) -> DataFrame:
    """docs(key, texts array<string>) -> (key, type, chain, n_mentions, n_names): how many entities a document's chains have, and by how many names.

    tokens(text) as for annotations.entities_in(). Chains are made within the row: no entity or name is shuffled or written.
    """
    kind = docs.schema[key].dataType.simpleString()

    def own(lists: list[str | None]) -> tuple[Counter, Counter]:
        """The entities and the names of each (type, chain)."""
        found = []
        for text in lists:
            if text is not None:
                sents, idxs, words, kinds, _, _ = tokens(text)
                for a, b in annotations.runs(sents, idxs, words, kinds):
                    if entity := " ".join(words[a : b + 1]):
                        found.append((kinds[a], (sents[a], idxs[a]), entity))
        ends = chain_ends(found)
        n = Counter((k, e.lower()) for k, _, e in found)
        mentions = Counter()
        for name, times in n.items():
            mentions[name[0], ends[name]] += times
        return mentions, Counter((name[0], end) for name, end in ends.items())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, annotations.SLICE):
                part = batch.slice(lo, annotations.SLICE)
                made = [own(lists or []) for lists in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(made)), [len(m) for m, _ in made])
                keys = [k for m, _ in made for k in m]
                columns = [[k[0] for k in keys], [k[1] for k in keys], [n for m, _ in made for n in m.values()], [names[k] for m, names in made for k in m]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *arrays], names=[key, "type", "chain", "n_mentions", "n_names"])

    return docs.select(key, texts).mapInArrow(take, f"`{key}` {kind}, type string, chain string, n_mentions long, n_names long")
