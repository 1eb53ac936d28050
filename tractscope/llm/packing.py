"""Packing token sequences by first-fit decreasing in randomised groups.

1. Every whole text becomes ids (those of the vocabulary's tokenizer, no added
   specials, then the end id) and is cut into pieces of ``LENGTH`` ids and a
   remainder; only offsets, lengths and checksums are kept, written once.
2. Documents are dealt into groups of about ``GROUP`` at random (a hash of
   their place in the written table, so equal rows spread too).
3. In each group, full pieces take a sequence of their own; remainders, longest
   first, go into the first sequence with room, found in a tournament tree of
   free capacities in logarithmic time.

Sequence ids are ``group << 32`` plus the number within the group.

Defined cases: a null or empty text is the end id alone; repeated rows and null
ids are packed like others, each row its own pieces; an empty table gives no
piece; other columns are ignored.

Scale: one shuffle of one small row per document; a group's size does not
depend on the table's.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_rows, saved

LENGTH = 1024
GROUP = 2048
END_ID = 0
LONG_BLANK = 10_000      # a run of white space from which the library itself encodes the text
# Fixed value: the byte-level pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Byte strings of a byte-level vocabulary with their ids, or None where
    ids do not follow the order of the merges."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(vocab) - len(merges)
    if first != 256 or any(vocab.get(left + right) != first + i for i, (left, right) in enumerate(merges)):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


class ByteTokens:
    """Ids of a byte-level tokenizer file.

    Ordinary text goes through the same merges as ranks in ``tiktoken``, which
    is faster and gives the same ids (compared in the tests on every code
    point, every token and mixed texts).  The library itself encodes texts that
    hold one of its added tokens or a very long run of white space, and all
    texts of a vocabulary of another kind."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        self.added = [t["content"] for t in parts["added_tokens"]]
        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        plain = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                 and parts["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout"))
        ranks = byte_ranks(model) if plain else None
        self.fast = None if ranks is None else tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._blank = re.compile(rf"\s{{{LONG_BLANK}}}")

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        if self.fast is None or any(t in text for t in self.added) or len(text) >= LONG_BLANK and self._blank.search(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return _packed(self.fast.encode_ordinary(text))


def _packed(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteTokens:
    return ByteTokens(path)


def cut_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, doc_tokens, crcs) with the checksum of each piece."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        tokens = load(vocabulary)
        out: dict[str, list] = {"id": cols[id_col], "doc_tokens": [], "crcs": []}
        for text in cols[text_col]:
            ids = tokens.ids(text or "") + _packed([END_ID])
            out["doc_tokens"].append(len(ids) // 4)
            out["crcs"].append([zlib.crc32(ids[a:a + 4 * LENGTH]) for a in range(0, len(ids), 4 * LENGTH)])
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), run, f"id {kind}, doc_tokens long, crcs array<long>")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first (ties by position), each into
    the first bin with room.  ``tree[1]`` is the largest free capacity; the
    leaves are the bins in order, an unopened bin being all free."""
    n = len(lengths)
    size = 1
    while size < max(n, 1):
        size *= 2
    tree = [capacity] * (2 * size)
    place, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.lexsort((np.arange(n), -lengths)).tolist():
        need, at = int(lengths[i]), 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        place[i], offset[i] = at - size, capacity - tree[at]
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return place, offset


def _pack_group(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        tokens = rows["doc_tokens"].to_numpy(dtype=np.int64)
        full, rest = tokens // length, tokens % length
        left = np.flatnonzero(rest > 0)
        bins, at = first_fit_decreasing(rest[left], length)
        n_bins = int(bins.max()) + 1 if len(bins) else 0
        doc = np.concatenate([np.repeat(np.arange(len(rows)), full), left])
        first = np.cumsum(full) - full
        nth = np.concatenate([np.arange(int(full.sum())) - np.repeat(first, full), full[left]])
        size = np.concatenate([np.full(int(full.sum()), length), rest[left]])
        seq = np.concatenate([n_bins + np.arange(int(full.sum())), bins])
        crc = [rows["crcs"].iat[d][k] for d, k in zip(doc.tolist(), nth.tolist())]
        group = int(rows["grp"].iat[0])
        return pd.DataFrame({
            "id": rows["id"].to_numpy()[doc], "start": nth * length, "length": size, "ids_crc32": np.array(crc, dtype=np.int64),
            "doc_tokens": tokens[doc], "sequence_id": (group << 32) + seq,
            "offset": np.concatenate([np.zeros(int(full.sum()), dtype=np.int64), at])})

    return run


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   group: int = GROUP) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    if length != LENGTH:
        raise ValueError(f"pieces are cut at {LENGTH}")
    arrow_batches(docs.sparkSession)
    cut = saved(cut_documents(docs, vocabulary, id_col, text_col))
    groups = max(1, -(-cut.count() // group))
    # the written rows' places are fixed, so the random deal is the same on every read
    dealt = cut.withColumn("place", F.monotonically_increasing_id()).withColumn(
        "grp", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    # ids as text on the way through pandas: integers with nulls would become floats
    packed = dealt.withColumn("id", F.col("id").cast("string")).groupBy("grp").applyInPandas(
        _pack_group(length), "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
