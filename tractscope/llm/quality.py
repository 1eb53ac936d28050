"""Quality rules: base counts and a calibrated n-gram classifier.

* **Features.** Hashed word uni- and bigrams and hashed character 3- and
  4-grams (bytes), as shares of their kind, ``BUCKETS`` numbers per text.
* **Training.** Logistic regression on at most ``SAMPLE`` labelled rows (those
  with the smallest id hashes), three quarters to fit, one quarter held out to
  calibrate the margins into probabilities (Platt scaling).
* **Scoring.** In Arrow batches over whole texts; a text is kept if it passes
  the base rules and its probability of good quality is ``MIN_QUALITY`` or more.

A feature's weight times its share, summed, is the mean weight over the text's
n-grams, so scoring needs one pass and no per-text table.

Defined cases: null texts have no words and fail; texts without words fail;
with fewer than two classes among the labels the classifier is left out and the
base rules decide alone; labels of unknown ids or null quality are ignored; of
conflicting labels of an id the good one counts, of several texts of a labelled
id the one of least hash is trained on, so partitioning decides nothing;
repeated rows give repeated results; very long texts are scored whole; other
columns are carried or ignored.  Two thousand rows cannot tell more than a few
thousand features apart, hence the small number of buckets.

The classifier (weights of fixed size) is the only thing that passes through
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, arrow_schema, map_rows

BUCKETS = 4096                 # half for words, half for characters
SAMPLE = 2000                  # labelled rows the classifier sees at most
MIN_WORDS = 50                 # base rule
MAX_REPEAT_PERCENT = 50        # base rule
MIN_QUALITY = 0.3              # of the calibrated probability
SYMBOLS = "#*$%&|<>"
_HALF = BUCKETS // 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _bucket(h: np.ndarray) -> np.ndarray:
    """The upper bits of a multiplicative hash, below ``_HALF``."""
    return ((h * _MIX) >> np.uint64(64 - _HALF.bit_length() + 1)).astype(np.int64)


def _powers(n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if len(_kept.get("p", ())) < n + 1:
        p = np.full(max(n + 1, 1 << 16), _STEP, dtype=np.uint64)
        p[0] = 1
        _kept["p"] = np.multiply.accumulate(p)
    return _kept["p"][:n + 1]


def ngram_buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word uni- and bigrams and of the character 3- and 4-grams."""
    b = np.frombuffer(data, dtype=np.uint8)
    u = b.astype(np.uint64)
    if len(b) >= 3:
        tri = (u[:-2] << np.uint64(16)) | (u[1:-1] << np.uint64(8)) | u[2:]
        quad = (tri[:-1] << np.uint64(8)) | u[3:] | np.uint64(1 << 40)
        chars = _bucket(np.concatenate([tri, quad]))
    else:
        chars = np.empty(0, dtype=np.int64)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if len(start) == 0:
        return np.empty(0, dtype=np.int64), chars
    # polynomial hash of each word from running sums: sum of (byte + 1) * step**offset
    p = _powers(int((end - start).max()))
    offset = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else None
    if offset is None:
        offset = np.arange(len(b)) - np.concatenate([np.zeros(start[0], dtype=np.int64), np.repeat(start, np.diff(np.append(start, len(b))))])
    term = np.where(blank, np.uint64(0), (u + np.uint64(1)) * p[np.minimum(offset, len(p) - 1)])
    word = np.add.reduceat(term, start)
    pair = word[:-1] * _STEP + word[1:] * _MIX
    return _bucket(np.concatenate([word, pair])), chars


def _shares(data: bytes) -> np.ndarray:
    words, chars = ngram_buckets(data)
    x = np.zeros(BUCKETS, dtype=np.float32)
    if len(words):
        x[:_HALF] = np.bincount(words, minlength=_HALF) / len(words)
    if len(chars):
        x[_HALF:] = np.bincount(chars, minlength=_HALF) / len(chars)
    return x


@dataclass(frozen=True)
class Classifier:
    """Weights per bucket, and the calibration of the margin."""
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, data: bytes) -> float:
        words, chars = ngram_buckets(data)
        z = self.bias
        if len(words):
            z += float(self.weights[:_HALF][words].mean())
        if len(chars):
            z += float(self.weights[_HALF:][chars].mean())
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; columns scaled by their spread."""
    spread = x.std(axis=0) + 1e-4
    z = (x / spread).astype(np.float32)
    v = np.ones(z.shape[1], dtype=np.float32)
    for _ in range(10):  # the largest curvature bounds the step
        v = z.T @ (z @ (v / np.linalg.norm(v))) / len(y)
    rate = 1 / (0.25 * (float(np.linalg.norm(v)) * 1.2 + 1.0) + ridge)
    w, b, vw, vb = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    for t in range(rounds):
        m = t / (t + 3)
        aw, ab = w + m * vw, b + m * vb
        e = 1 / (1 + np.exp(-np.clip(z @ aw.astype(np.float32) + ab, -50, 50))) - y
        nw, nb = aw - rate * (z.T @ e.astype(np.float32) / len(y) + ridge * aw), ab - rate * float(e.mean())
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w / spread, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Classifier | None:
    """The classifier, or None where the labels hold fewer than two classes.

    The sample (at most ``sample`` rows, chosen by id hash) is the broadcast
    side of the join; only its feature rows come to the driver."""
    picked = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
              .agg(F.max(label_col).alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), F.col("__doc") == F.col("__id")).select("__id", "y", F.xxhash64("text").alias("th"), "text")

    def features(cols: dict[str, list]) -> dict[str, list]:
        return {"id": cols["__id"], "y": cols["y"], "th": cols["th"], "x": [_shares((t or "").encode("utf-8", "surrogatepass")).tobytes() for t in cols["text"]]}

    # of texts that share an id the one of least hash, whatever the partitioning
    one = map_rows(rows, features, "id long, y int, th long, x binary").groupBy("id", "y").agg(F.min(F.struct("th", "x")).alias("t"))
    got = sorted(one.select("id", "y", "t.x").collect(), key=lambda r: r.id)
    y = np.array([r.y for r in got], dtype=np.float64)
    if len(set(y)) < 2:
        return None
    x = np.array([np.frombuffer(r.x, dtype=np.float32) for r in got])
    held = np.arange(len(got)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(got), dtype=bool)
    w, b = _fit_logistic(x[~held], y[~held], 1e-3, 300)
    fit = held if held.any() else ~held
    margin = x[fit] @ w + b
    scale = float(margin.std()) or 1.0
    # Platt's targets: never quite 0 or 1
    good, poor = float((y[fit] == 1).sum()), float((y[fit] == 0).sum())
    target = np.where(y[fit] == 1, (good + 1) / (good + 2), 1 / (poor + 2))
    slope, offset = 1.0, 0.0
    m = margin / scale
    for _ in range(2000):
        e = 1 / (1 + np.exp(-np.clip(slope * m + offset, -50, 50))) - target
        slope, offset = slope - float((e * m).mean()), offset - float(e.mean())
    return Classifier(w, b, slope / scale, offset)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    word_chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, i) for i, w in enumerate(words)], dtype=np.int64)
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, which, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k:n - 2 + k] |= again
    return int(inside.sum())


def _judge(text: str | None, model: Classifier | None) -> tuple:
    text = text or ""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    p = None if model is None else model.probability(text.encode("utf-8", "surrogatepass"))
    return (*counts, failed, not failed and (p is None or p >= MIN_QUALITY), p)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: base counts, base verdict, verdict, probability."""
    model = train(docs, labels, sample, id_col, text_col)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")

    def judge(cols: dict[str, list]) -> dict[str, list]:
        rows = [_judge(t, model) for t in cols[text_col]]
        return {id_col: cols[id_col]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), judge, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, "
                    "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    model = train(docs, labels, sample, id_col, text_col)
    arrow_batches(docs.sparkSession)
    target = arrow_schema(T.StructType(docs.schema.fields))

    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            kept = batch.filter(pa.array([_judge(t, model)[6] for t in texts], pa.bool_()))
            if kept.num_rows:
                yield kept.cast(target) if kept.schema != target else kept

    return docs.mapInArrow(keep, docs.schema)
