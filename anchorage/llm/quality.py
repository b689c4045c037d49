"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word, a number, or a run of marks.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
BITS = 18
#: Tokens hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 18
_CASE = (b"a", b"A", b"Aa", b"0", b"#")


def _shape(t: bytes) -> bytes:
    """Letters in lower, upper or title case, digits, or the marks themselves (a bounded number of them)."""
    c = t[0]
    if c >= 0x80 or 65 <= (c & 0xDF) <= 90:
        return _CASE[0] if t.islower() or not t[:1].isupper() else _CASE[1] if t.isupper() and len(t) > 1 else _CASE[2]
    return _CASE[3] if 48 <= c <= 57 else t[:3]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and their values, of Euclidean length 1; none for a text without tokens.

    Features are hashed n-grams of words (1, 2), of their shapes (1, 2, 3), and of marks that say whether a token stood
    among the 8 before it (1, 2), by which a text that repeats itself shows whatever it repeats.
    """
    raw = (text or "").encode("utf-8", "replace")
    idx, cnt = np.zeros(0, dtype=np.int64), np.zeros(0)
    tokens: list[bytes] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not tokens:
            return
        word = np.fromiter((zlib.crc32(t.lower()) for t in tokens), dtype=np.uint64, count=len(tokens))
        kind = np.fromiter((zlib.crc32(_shape(t)) for t in tokens), dtype=np.uint64, count=len(tokens))
        again = np.zeros(len(word), dtype=np.uint64)
        for k in range(1, min(9, len(word))):
            again[k:][(word[k:] == word[:-k]) & (again[k:] == 0)] = k
        grams = [_gram([word], 1), _gram([word[:-1], word[1:]], 2)]
        grams += [_gram([kind], 3), _gram([kind[:-1], kind[1:]], 4), _gram([kind[:-2], kind[1:-1], kind[2:]], 5), _gram([again], 6), _gram([again[:-1], again[1:]], 7)]
        parts.append(np.unique(np.concatenate(grams), return_counts=True))
        tokens.clear()

    for m in TOKEN.finditer(raw):
        tokens.append(m[0])
        if len(tokens) == CHUNK:
            flush()
    flush()
    if parts:
        idx, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        cnt = np.bincount(where, weights=np.concatenate([p[1] for p in parts]))
        cnt = np.sqrt(cnt)
        cnt /= np.sqrt((cnt * cnt).sum())
    return idx, cnt


def _gram(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), (salt * 0x9E3779B97F4A7C15) & (2**64 - 1), dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        idx, x = features(text)
        z = float(self.weights[idx] @ x) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> Model:
    """Follow-the-regularised-leader (proximal) over the examples' features in the order given, `epochs` times."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(epochs):
        for (idx, x), y in zip(rows, labels, strict=True):
            i, v = np.append(idx, 1 << BITS), np.append(x, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ v, -35, 35))) - y) * v
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - sigma * wi
            n[i] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn, doc_id, quality, same, text) -> the same with the text's features in its place."""
    schema = pa.schema([("turn", pa.int64()), ("doc_id", pa.int64()), ("quality", pa.int32()), ("same", pa.int64()), ("idx", pa.binary()), ("val", pa.binary())])
    for b in batches:
        rows = [features(t.as_py()) for t in b.column("text")]
        packed = [pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(c).cast(schema.field(c).type) for c in schema.names[:4]] + packed, schema=schema)


def _fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["turn", "doc_id", "quality", "same"])
    y = pdf["quality"].tolist()
    rows = [(np.frombuffer(i, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for i, v in zip(pdf["idx"], pdf["val"], strict=True)]
    m = fit(rows, y) if len(set(y)) == 2 else Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    return pd.DataFrame({"weights": [zlib.compress(m.weights.tobytes())], "bias": [m.bias]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    """A model from labelled documents, whose crc32(doc_id as text) mod 5 is not 0.

    The fit takes a bounded sample, the documented bound being max_rows labelled documents, the first in a seeded hash
    order, each by its whole text. Features are found where the texts lie; the fit runs in one executor task, which gets
    at most 2^18 numbers for each document and no text, and the driver gets 2^18 weights. Labels that are null or not 0
    or 1 are passed over; a document labelled twice counts twice. Without usable labels of both kinds all scores are 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    # The order by a hash makes a sample; ties go on by document, so that reruns agree.
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "quality").limit(max_rows)
    turn = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(" 4")).cast("binary")).alias("turn")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select(turn, "doc_id", "quality", F.xxhash64("text").alias("same"), "text")
    rows = rows.mapInArrow(_featurise, "turn long, doc_id long, quality int, same long, idx binary, val binary")
    # Documents that stand many times in the table cannot make the fit larger than its bound either.
    rows = rows.orderBy("turn", "doc_id", "quality", "same").limit(max_rows)
    got = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_fit_rows, "weights binary, bias double").first()
    if got is None:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    return Model(np.frombuffer(zlib.decompress(got["weights"]), dtype=np.float32), got["bias"])


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> (doc_id, held_out, score, predicted, text_hash), a row for each row of docs.

    score is the probability of label 1 from the whole text; predicted is 1 from `threshold` on. Null, empty and
    tokenless texts get the score of the bias. held_out is false for a null doc_id. Repeated rows each get the same.
    Labels are read for training alone, and lang, source and doc_id are no inputs of a score.
    """
    model = train(docs, labels, max_rows)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype=float)

    out = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _held_out(F.col("doc_id")).alias("held_out"), of("text").alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject; scored in the scan, without a shuffle."""
    model = train(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) >= threshold for t in b.column("text")], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
