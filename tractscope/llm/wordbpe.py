"""BPE encoding and decoding by a priority queue over a linked symbol list.

A pre-token starts as the list of its symbols, each linked to its neighbours;
every adjacent pair that the merge table knows is queued by (rank, position).
The smallest entry is taken; if one of its symbols was merged meanwhile it is
stale and skipped, else both become one symbol and the new pairs on either side
are queued.  Decoding concatenates the vocabulary's strings.

Normalising and cutting into pre-tokens follow the vocabulary file: by its own
normaliser and pre-tokeniser, and for runs of Latin letters by an equal regular
expression.  Pre-tokens and whole blank-separated chunks are remembered in
bounded tables, kept by a Python worker from task to task.

Defined cases: a null text is empty: no ids, empty decoded text; control
strings of the vocabulary inside a text become their ids, as in the library;
symbols the vocabulary lacks are dropped (the byte symbols are all in it, so no
character of a text is lost, control characters included); repeated rows give
repeated results; very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows

REMEMBERED = 300_000   # entries of each table, which is emptied when full
SHORT = 64             # characters of the longest entry
LATIN = "ɏ"       # up to here normalising is lower-casing, letter by letter
# Fixed value: the file's pattern, for Latin text (no combining marks).
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Other lower case, numbers that are no digits, blanks, and control characters (not their own byte symbols): as the library cuts them.
_ODD_LATIN = re.compile("[İ²³¹¼-¾\u0000-\u0008\u000e-\u001f\u007f]")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable,
    else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merges = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.control).items()}
        self._control_split = re.compile("(" + "|".join(map(re.escape, sorted(self.control, key=len, reverse=True))) + ")")
        library = Tokenizer.from_file(path)  # for its normaliser and pre-tokeniser alone
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.bytes = _byte_symbols()
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[bytes, str]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """``symbols`` after all merges, smallest rank first, leftmost first among equals."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.merges
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                 if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        alive = symbols[:]
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j >= n or alive[i] != left or alive[j] != right:
                continue  # stale: one of the two was merged away
            alive[i], alive[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((alive[i], alive[k]))) is not None:
                    heapq.heappush(queue, (r, i, alive[i], alive[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((alive[h], alive[i]))) is not None:
                heapq.heappush(queue, (r, h, alive[h], alive[i]))
        return [s for s in alive if s]

    def _piece(self, shown: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in byte symbols."""
        ids = self._pieces.get(shown)
        if ids is None:
            symbols = [*shown[:-1], shown[-1] + self.suffix]
            ids = tuple(i for s in self.merge([s for s in symbols if s in self.vocab]) if (i := self.vocab.get(s)) is not None)
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            if len(shown) <= SHORT:
                self._pieces[shown] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without control strings."""
        ids: list[int] = []
        if (text.isascii() or max(text) <= LATIN) and not _ODD_LATIN.search(text):
            shown = self.bytes
            for piece in _PIECE.findall(text.lower()):
                ids += self._piece(piece if piece.isascii() else "".join([shown[b] for b in piece.encode()]))
        else:
            for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text)):
                ids += self._piece(piece)
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self._control_split.split(text) if "<|" in text else (text,):
            if part in self.control:
                ids.append(self.control[part])
            elif part:
                ids += self._plain(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, one blank between (the file has no decoder)."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])

    def digest(self, text: str) -> tuple[int, bytes, str]:
        """(number of ids, the ids as little-endian 32-bit numbers, decoded text).

        Cutting at blanks first changes nothing: no pre-token or control string
        holds one, and no mark composes with it."""
        chunks, kept = [], self._chunks
        for chunk in text.split(" "):
            got = kept.get(chunk)
            if got is None:
                ids = self.encode(chunk)
                got = (_packed(ids), self.decode(ids))
                if len(kept) >= REMEMBERED:
                    kept.clear()
                if len(chunk) <= SHORT:
                    kept[chunk] = got
            if got[0]:
                chunks.append(got)
        packed = b"".join([c[0] for c in chunks])
        return len(packed) // 4, packed, " ".join([c[1] for c in chunks])


def _packed(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The encoder of a vocabulary file, once per Python worker."""
    return WordBpe(path)


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the decoded text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        bpe = load(vocabulary)
        out: dict[str, list] = {id_col: cols[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols[text_col]:
            n, packed, decoded = bpe.digest(text or "") if text else (0, b"", "")
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
