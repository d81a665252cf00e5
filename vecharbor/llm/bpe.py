"""Byte-pair encoding and decoding by a public vocabulary file; nothing is trained.

Each piece of the pre-tokenised text is a doubly linked list of symbols. Adjacent pairs that
the vocabulary merges wait in a priority queue by (rank, place); a popped entry whose symbols
have changed meanwhile is stale and skipped; a merge puts its two new neighbours on the queue.
Time is n log n in the piece's length. Decoding joins vocabulary strings.

The file says how text is cut: normal form C, runs of white space to a space, lower case, a
pattern whose matches are the pieces, bytes shown as printable characters, and a suffix that
marks a piece's last symbol.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import as_texts, map_texts

#: Pieces kept with their codes, per Python worker, in each of two generations.
CACHE_PIECES = 200_000
CACHE_PIECE_CHARS = 40

_PLAIN = re.compile("[\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]*")
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u024f]+|[0-9]|[^\\s0-9a-z\xdf-\xf6\xf8-\u024f]+")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Encoder:
    """Encoder of one vocabulary file whose model is BPE with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Beyond common Latin letters, what is a letter, a number or lower case depends on the
        # version of Unicode: those texts are normalised and cut by the file's own library.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = Split(Regex(pattern), "removed", invert=True)
        self.latin = _LATIN if pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" else None
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.shown = _byte_characters()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece."""
        shown = [self.shown[b] for b in piece.encode("utf-8", "surrogatepass")]
        shown[-1] += self.suffix
        symbols = [self.ids[c] for c in shown if c in self.ids]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                found = merges.get((new, symbols[after]))
                if found:
                    heapq.heappush(queue, (found[0], i, new, symbols[after], found[1]))
            before = left[i]
            if before >= 0:
                found = merges.get((symbols[before], new))
                if found:
                    heapq.heappush(queue, (found[0], before, symbols[before], new, found[1]))
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> list[str]:
        if self.latin and _PLAIN.fullmatch(text):
            lower = text.lower()
            # Some capitals of the range have their lower case beyond it.
            if lower.isascii() or _PLAIN.fullmatch(lower):
                return self.latin.findall(lower)
        return [piece for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _coded(self, piece: str) -> tuple[bytes, str]:
        ids = self.merge(piece)
        return b"".join(i.to_bytes(4, "little") for i in ids), " ".join([self.strings[i] for i in ids])

    def _segment(self, text: str) -> tuple[list[bytes], list[str]]:
        pieces = self.pieces(text)
        known = self.known
        if len(known) > CACHE_PIECES:
            # Pieces that come again are taken over from the older generation.
            self.older, known = known, {}
            self.known = known
        long: dict[str, tuple[bytes, str]] = {}
        for p in set(pieces):
            if p not in known:
                (known if len(p) <= CACHE_PIECE_CHARS else long)[p] = self.older.get(p) or self._coded(p)
        if long:
            both = [known.get(p) or long[p] for p in pieces]
        else:
            both = [known[p] for p in pieces]
        return [x[0] for x in both], [x[1] for x in both]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        if not text:
            return b"", ""
        if not self.specials or not self.specials.search(text):
            ids, words = self._segment(text)
        else:
            ids, words, at = [], [], 0
            for m in self.specials.finditer(text):
                more = self._segment(text[at : m.start()])
                ids += [*more[0], self.special[m[0]].to_bytes(4, "little")]
                words += [*more[1], m[0]]
                at = m.end()
            more = self._segment(text[at:])
            ids += more[0]
            words += more[1]
        return b"".join(ids), " ".join([w for w in words if w])

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings of the ids, joined as the file's lack of a decoder says: by a space."""
        return " ".join(self.strings[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


@cache
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, so that its cache serves all tasks."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` names a vocabulary file that is present on every executor. Null counts as empty:
    no tokens. A text of any length is encoded whole. One map, no shuffle; other columns are
    not read.
    """

    def make():
        coder = encoder(path)

        def kernel(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in as_texts(batch.column("text")):
                ids, decoded = coder.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            return {"doc_id": batch.column("doc_id"), **out}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token ids and the decoded text of each row."""

    def make():
        coder = encoder(path)

        def kernel(batch: pa.RecordBatch) -> dict:
            both = [coder.encode(t) for t in as_texts(batch.column("text"))]
            ids = [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x, _ in both]
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [t for _, t in both]}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id bigint, ids array<int>, decoded string")
