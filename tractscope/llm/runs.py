"""Periodic runs of words by an online sparse diagonal DP, and texts with runs collapsed.

A run is a longest stretch of consecutive words with smallest period q (words
q apart are identical) of at least ``max(MIN_LENGTH, MIN_PERIODS * q)`` words.

The table of all (word, earlier word) pairs is sparse: only equal pairs count,
and a run of period q is a stretch of the diagonal of lag q.  Words are taken
in order; the earlier occurrences of each extend the match lengths of the
active lags, a lag without one ends, and a diagonal that ends long enough emits
its run at once (:func:`_diagonals`).

Two things keep this near-linear on every text, one word repeated a million
times included:

* Lags are taken an octave [k, 2k) at a time, the symbol at a position being
  the k words from there (ranks by doubling).  A run of lag q >= k holds each
  of its k-word symbols three times at least, so rarer symbols drop out of this
  and all later octaves; ordinary prose has almost none left after k = 4.
* A symbol with more than two earlier occurrences in the octave is itself
  periodic with a period below k/2.  Not all of q consecutive positions of a
  run of smallest period q can be such (the run would have the smaller
  period), so only positions with one or two open or extend a diagonal, and at
  most two lags are active at a time.  Symbols inside a run already emitted
  repeat it and are left out.  The ends of a diagonal are found by comparing
  symbols of k, k/2, ..., 1 words.

Defined cases: a null or blank text has no words and no run, its collapsed text
is empty (null stays null in :func:`collapse_runs`); repeated rows and null ids
give a row each; an empty table gives an empty result; other columns, whatever
their names, take no part.  A text is one row and is worked on whole: about 60
bytes a word, and 4 bytes a word and octave where it is periodic throughout.

Scale: one pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MIN_LENGTH, MIN_PERIODS = 6, 4
GROUP_WORDS = 100_000      # texts of a batch worked on together, a longer one alone
#: A word, in the patterns of SQL functions (bytes.split cuts at the same six blanks).
WORD = r"[^\x20\x09-\x0D]+"


class Symbols:
    """Ranks of the k-word symbols of several texts laid end to end, k = 1, 2, 4, ...

    Equal symbols of one text have equal ranks; 0 is a symbol that its text
    holds fewer than three times (no run can hold it), or one that crosses
    the end of its text."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n = len(words)
        self.tables = [self._rank(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, np.arange(self.n))]

    def _rank(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        kept = counts >= MIN_PERIODS - 1
        rank = np.where(kept, np.cumsum(kept), 0)[inverse]
        table = np.zeros(self.n + 1, dtype=np.int32)
        table[at] = rank
        return table

    def double(self) -> bool:
        """Add the ranks of symbols twice as long; False if none is left."""
        last, k = self.tables[-1], 1 << (len(self.tables) - 1)
        at = np.flatnonzero(last[:max(0, self.n - k)])
        at = at[last[at + k] > 0]
        if not len(at):
            return False
        key = last[at].astype(np.int64) * (int(last.max()) + 1) + last[at + k]
        self.tables.append(self._rank(key, at))
        return bool(self.tables[-1].any())

    def same(self, octave: int, a: int, b: int) -> bool:
        """Whether the symbols at ``a`` > ``b`` of this octave are equal (and could lie in a run)."""
        table = self.tables[octave]
        return b >= 0 and a < self.n and table[a] > 0 and table[a] == table[b]

    def earlier(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, lag), in order, of every position with one or two earlier
        occurrences of its symbol in the octave's lags."""
        table, k = self.tables[-1], 1 << (len(self.tables) - 1)
        if k == 1:
            at = np.flatnonzero((table[1:self.n] == table[:self.n - 1]) & (table[1:self.n] > 0)) + 1
            return at, np.ones(len(at), dtype=np.int64)
        at = np.flatnonzero(table[:self.n])
        at = at[np.argsort(table[at], kind="stable")]
        base = table[at].astype(np.int64) * (self.n + 1)
        key = base + at
        low = np.searchsorted(key, base + np.maximum(at - (2 * k - 1), 0))
        high = np.searchsorted(key, base + np.maximum(at - k, -1), side="right")
        found = high - low
        one, two = (found == 1) | (found == 2), found == 2
        pos = np.concatenate([at[one], at[two]])
        lag = pos - np.concatenate([at[low[one]], at[low[two] + 1]])
        # a run's first such position matches one lag further on, its last one a lag further back
        ahead = np.minimum(pos + lag, self.n)
        behind = np.maximum(pos - 2 * lag, 0)
        here = table[pos]
        fit = (table[ahead] == here) | (table[behind] == here)
        pos, lag = pos[fit], lag[fit]
        order = np.lexsort((lag, pos))
        return pos[order], lag[order]


def _ends(symbols: Symbols, octave: int, first: int, last: int, lag: int) -> tuple[int, int]:
    """[start, end) of the matched positions of a diagonal known to match from
    ``first`` through the symbol at ``last``."""
    k = 1 << octave
    end = last + k
    while symbols.same(octave, end, end - lag):
        end += k
    start = first
    while symbols.same(octave, start - k, start - k - lag):
        start -= k
    for j in range(octave - 1, -1, -1):
        step = 1 << j
        if symbols.same(j, end, end - lag):
            end += step
        if symbols.same(j, start - step, start - step - lag):
            start -= step
    return start, end


def _diagonals(symbols: Symbols, octave: int, at: list[int], lags: list[int]) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of one octave's lags."""
    k, emitted, active = 1 << octave, set(), {}      # lag -> [first, last] matched symbol

    def ended(lag: int, first: int, last: int) -> None:
        start, end = _ends(symbols, octave, first, last, lag)
        length = end - start + lag
        if length >= max(MIN_LENGTH, MIN_PERIODS * lag):
            emitted.add((start - lag, length, lag))

    for i, lag in zip(at, lags):
        for other in [q for q, d in active.items() if d[1] + k < i]:
            ended(other, *active.pop(other))
        diagonal = active.get(lag)
        if diagonal is None:
            active[lag] = [i, i]
        else:
            diagonal[1] = i
    for lag, d in active.items():
        ended(lag, *d)
    return emitted


def _uncovered(runs: set[tuple[int, int, int]], at: np.ndarray, lags: np.ndarray, k: int) -> np.ndarray:
    """Which symbols, with their earlier occurrence, do not lie in one emitted run."""
    if not runs:
        return np.ones(len(at), dtype=bool)
    spans = np.array(sorted((s, s + n) for s, n, _ in runs), dtype=np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.searchsorted(spans[:, 0], at - lags, side="right") - 1
    return (before < 0) | (reach[np.maximum(before, 0)] < at + k)


def word_runs(texts: Sequence[Sequence]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    codes: dict = {}
    words = np.fromiter((codes.setdefault(w, len(codes)) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    symbols = Symbols(words, np.repeat(np.arange(len(texts)), sizes))
    runs: set[tuple[int, int, int]] = set()
    octave = 0
    while MIN_PERIODS << octave <= int(sizes.max()):
        at, lags = symbols.earlier()
        fresh = _uncovered(runs, at, lags, 1 << octave)
        runs |= _diagonals(symbols, octave, at[fresh].tolist(), lags[fresh].tolist())
        octave += 1
        if not symbols.double():
            break
    for start, length, period in sorted(runs, key=lambda r: (r[0], r[2])):
        d = int(np.searchsorted(firsts, start, side="right")) - 1
        out[d].append((start - int(firsts[d]), length, period))
    return out


def kept_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _grouped(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The texts' words, consecutive texts of about ``GROUP_WORDS`` words at a time."""
    group: list[list[bytes]] = []
    held = 0
    for text in texts:
        words = (text or b"").split()
        if held and held + len(words) > GROUP_WORDS:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, runs, collapsed), the runs as an
    array of (start, length, period) and the kept words joined by one space."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": cols["id"], "n_words": [], "runs": [], "collapsed": []}
        for group in _grouped(cols["text"]):
            for words, found in zip(group, word_runs(group)):
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                out["collapsed"].append(b" ".join(words).decode("utf-8", "replace"))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = map_rows(rows, run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every text's runs collapsed to one period, words joined by
    one space; a null text stays null, other columns pass as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row"), F.col(text_col).cast("binary").alias("t"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: list[str] = []
        for group in _grouped(cols["t"]):
            for words, found in zip(group, word_runs(group)):
                stay = np.flatnonzero(kept_words(len(words), found)).tolist() if found else range(len(words))
                out.append(b" ".join([words[i] for i in stay]).decode("utf-8", "replace"))
        return {"doc_row": cols["doc_row"], "t": [None if t is None else c for t, c in zip(cols["t"], out)]}

    kind = whole.schema["doc_row"].dataType.simpleString()
    done = map_rows(whole, run, f"doc_row {kind}, t string")
    return done.select(*[(F.col("t") if c == text_col else F.col(f"doc_row.`{c}`")).alias(c) for c in docs.columns])


def with_cycles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the words of one document in ten repeating from some word
    on: with h = crc32 of the id's decimal digits, g = h div 10 and n words, where
    h ends in 0 word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) div (3 + g % 8).  A null id changes nothing."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)))

    def cycled(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    rows = docs.select(F.col(id_col), F.col(text_col), chosen.alias("cycle_words"))
    text = F.when(F.size("cycle_words") > 0, cycled(F.col("cycle_words"))).otherwise(F.col(text_col))
    return rows.select(F.col(id_col), text.alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from :func:`find_runs`: the number of runs, the one
    of greatest length / period (exact; ties: smallest start, then period),
    digests of all runs and of the collapsed text."""
    better = F.array_sort("runs", lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"],
                          F.signum(y["length"] * x["period"] - x["length"] * y["period"]))
                          .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
                          .otherwise(F.signum(x["period"] - y["period"])).cast("int"))
    best = F.get(better, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best_run"), "n_words",
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        id_col, "n_runs", "best_run.start", "best_run.length", "best_run.period",
        F.expr("best_run.length * 1000 div best_run.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
