"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter item. Its
tokens are its shingles of up to three words. Tokens are ordered by rarity: the number of
times each occurs in all documents, counted in a first pass. As a window must occur whole
(containment 1), its prefix is one token, the rarest; a document can hold the window only
where it holds that token. The join on prefix tokens gives (window, position) candidates;
the token's place in the window and the lengths of window and document bound the start; and
the words from that start are compared with the window's, one by one.

The benchmark side is broadcast in blocks of at most ``BLOCK_WORDS`` words, so what the driver
and executors hold is bounded whatever the benchmark's size (some 300 bytes a word at worst);
each block is one map over documents. An item of more words is cut in parts that share a window's words less one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .common import as_bytes, keep_rows, map_texts, materialize, slices, unused

WINDOW = 13
#: A document is contaminated if at least one in this many of its words is hit.
ONE_IN = 20
SHINGLE = 3
#: Benchmark words of one broadcast block.
BLOCK_WORDS = 500_000
#: Candidates that are verified at once.
VERIFY_ROWS = 200_000

#: Words: runs of digits, letters and anything beyond ASCII; A-Z in lower case.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Windows:
    """Distinct windows of one benchmark block."""

    vocabulary: dict[bytes, int]
    #: Word ids of each window, in rows padded with -2.
    words: np.ndarray
    lengths: np.ndarray
    #: Items that own each window: for window i, ``owners[owned[i]:owned[i + 1]]`` are places in ``items``.
    owned: np.ndarray
    owners: np.ndarray
    items: list[str]
    #: For each token width, sorted token codes of all windows of that width.
    codes: dict[int, np.ndarray]
    #: For each width: by token code's place in ``codes``, the windows it is the prefix of.
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def tokens(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Code of the token at each position (of each row); -1 where a word is not the benchmark's."""
        n = ids.shape[-1] - width + 1
        if n <= 0:
            return np.zeros((*ids.shape[:-1], 0), np.int64)
        base = max(len(self.vocabulary), 1)
        code, ok = np.zeros((*ids.shape[:-1], n), np.int64), np.ones((*ids.shape[:-1], n), bool)
        for k in range(width):
            part = ids[..., k : k + n]
            ok &= part >= 0
            code *= base
            code += part
        code[~ok] = -1
        return code

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known tokens and their places in ``codes``."""
        known = self.codes[width]
        code = self.tokens(ids, width)
        at = np.flatnonzero(code >= 0)
        if not len(at) or not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
        hit = known[place] == code[at]
        return at[hit], place[hit]


def build_windows(items: list[tuple[str, bytes]], window: int = WINDOW) -> Windows:
    vocabulary: dict[bytes, int] = {}
    rows, owners = [], []
    for k, (_, text) in enumerate(items):
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)), np.int32)
        if len(ids) >= window:
            mine = np.lib.stride_tricks.sliding_window_view(ids, window)
        elif len(ids):
            mine = np.r_[ids, np.full(window - len(ids), -2, np.int32)][None]
        else:
            continue
        rows.append(mine)
        owners.append(np.full(len(mine), k, np.int32))
    every = np.ascontiguousarray(np.concatenate(rows) if rows else np.zeros((0, window), np.int32))
    # Equal rows are equal byte strings.
    raw = every.view(np.dtype((np.void, window * 4))).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners) if owners else np.zeros(0, np.int32)], axis=1).astype(np.int64), axis=0)
    words = every[first]
    lengths = (words >= 0).sum(axis=1)
    out = Windows(vocabulary, words, lengths, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1].astype(np.int32), [name for name, _ in items], {})
    for width in range(1, SHINGLE + 1):
        codes = out.tokens(words[np.minimum(lengths, SHINGLE) == width], width)
        out.codes[width] = np.unique(codes[codes >= 0])
    return out


def choose_prefixes(w: Windows, counts: dict[int, np.ndarray]) -> None:
    """The rarest token of each window; of equally rare ones that of the lowest code, then the first."""
    w.prefix = {}
    for width, known in w.codes.items():
        owner = np.flatnonzero(np.minimum(w.lengths, SHINGLE) == width)
        codes = w.tokens(w.words[owner], width)
        if not len(owner):
            w.prefix[width] = (np.zeros(1, np.int64),) * 3
            continue
        at = np.searchsorted(known, codes)
        # Tokens in order of rarity, then of code.
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(counts[width], kind="stable")] = np.arange(len(known))
        order_of = np.where(codes >= 0, rank[np.minimum(at, len(known) - 1)], len(known))
        offset = order_of.argmin(axis=1)
        place = at[np.arange(len(owner)), offset]
        order = np.argsort(place, kind="stable")
        w.prefix[width] = (np.searchsorted(place[order], np.arange(len(known) + 1)), owner[order], offset[order])


def hits(w: Windows, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """Whether each word lies in an occurrence of a window, and the windows that occur."""
    n = len(words)
    mask, found = np.zeros(n, bool), set()
    if not n or w.vocabulary.keys().isdisjoint(words):
        return mask, found
    ids = w.ids(words)
    for width in w.codes:
        at, place = w.found(ids, width)
        if not len(at):
            continue
        starts, owner, offset = w.prefix[width]
        many = starts[place + 1] - starts[place]
        at, first, many = at[many > 0], starts[place][many > 0], many[many > 0]
        upto = np.cumsum(many)
        begin = 0
        while begin < len(at):
            # As many positions as make up one bounded block of candidates.
            base = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, base + VERIFY_ROWS, side="right")))
            m = many[begin:end]
            k = np.repeat(first[begin:end] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            win = owner[k]
            start = np.repeat(at[begin:end], m) - offset[k]
            begin = end
            fits = (start >= 0) & (start + w.lengths[win] <= n)
            win, start = win[fits], start[fits]
            if not len(win):
                continue
            span = np.arange(w.words.shape[1])
            text = ids[np.minimum(start[:, None] + span, n - 1)]
            same = ((text == w.words[win]) | (span >= w.lengths[win][:, None])).all(axis=1)
            win, start = win[same], start[same]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + w.lengths[win], -1)
            mask |= np.cumsum(edge[:-1]) > 0
            found.update(win.tolist())
    return mask, found


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items (id as text, bytes) in blocks of about ``block_words`` words, streamed to the driver."""
    held: list[tuple[str, bytes]] = []
    size, most = 0, max(block_words, window)
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    for name, value in rows.toLocalIterator():
        words = words_of(value.encode())
        for at in range(0, max(len(words) - window + 1, min(len(words), 1)), most):
            part = words[at : at + most + window - 1]
            if held and size + len(part) > block_words:
                yield held
                held, size = [], 0
            held.append((name, b" ".join(part)))
            size += len(part)
    if held:
        yield held


def _counted(docs: DataFrame, w: Windows) -> dict[int, np.ndarray]:
    """How often each token of ``w`` occurs in all documents: counts a task, summed by token."""
    spark = docs.sparkSession
    shared: Broadcast = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        totals = {width: np.zeros(len(c), np.int64) for width, c in own.codes.items()}
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                if own.vocabulary.keys().isdisjoint(words):
                    continue
                ids = own.ids(words)
                for width, total in totals.items():
                    if len(total):
                        total += np.bincount(own.found(ids, width)[1], minlength=len(total))
        for width, total in totals.items():
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width, np.int32)), pa.array(at), pa.array(total[at])], names=["width", "place", "n"])

    counts = {width: np.zeros(len(c), np.int64) for width, c in w.codes.items()}
    rows = docs.select("text").mapInArrow(run, "width int, place bigint, n bigint").groupBy("width", "place").agg(F.sum("n").alias("n"))
    for width, place, n in rows.toLocalIterator():
        counts[width][place] = n
    shared.destroy()
    return counts


def _prepared(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> list[Broadcast]:
    out = []
    for items in _blocks(benchmark, window, block_words):
        w = build_windows(items, window)
        choose_prefixes(w, _counted(docs, w))
        out.append(docs.sparkSession.sparkContext.broadcast(w))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    A null text has no words; items without id or words are left out; items that share an id
    count as one. Of a benchmark of several blocks, one block is in memory at a time: the hit
    words and items so far are written beside the rows between blocks. Other columns of either
    table are not read; empty tables give no rows, or rows without hits.
    """
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean"
    rows, last, marks = _all_but_last(docs.select("doc_id", "text"), _prepared(docs, benchmark, window, block_words))

    def make():
        block = last.value if last else None

        def kernel(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_words": [], "n_hit": [], "n_items": [], "items": [], "contaminated": []}
            for n, hit, names in _judged(block, batch, marks):
                out["n_words"].append(n)
                out["n_hit"].append(hit)
                out["n_items"].append(len(names))
                out["items"].append(sorted(names))
                out["contaminated"].append(hit > 0 and one_in * hit >= n)
            return {"doc_id": batch.column("doc_id"), **out}

        return kernel

    return map_texts(rows, make, schema)


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    rows, last, marks = _all_but_last(docs, _prepared(docs, benchmark, window, block_words))

    def make():
        block = last.value if last else None

        def kernel(batch: pa.RecordBatch) -> list[bool]:
            return [not (hit and one_in * hit >= n) for n, hit, _ in _judged(block, batch, marks)]

        return kernel

    return keep_rows(rows, make).select(*docs.columns)


def _judged(block: Windows | None, batch: pa.RecordBatch, marks: tuple[str, str] | None) -> Iterator[tuple[int, int, set[str]]]:
    """Words, hit words and item ids of each row, with what earlier blocks have marked."""
    for n, mask, names in _masks(block, batch, marks):
        yield n, int(mask.sum()), names


def _masks(block: Windows | None, batch: pa.RecordBatch, marks: tuple[str, str] | None) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    before = [batch.column(c).to_pylist() for c in marks] if marks else None
    for i, text in enumerate(as_bytes(batch.column("text"))):
        words = words_of(text)
        mask, names = np.zeros(len(words), bool), set()
        if block:
            mask, found = hits(block, words)
            names.update(block.items[k] for w in found for k in block.owners[block.owned[w] : block.owned[w + 1]])
        if before:
            packed, items = before[0][i], before[1][i]
            mask |= np.unpackbits(np.frombuffer(packed, np.uint8), count=len(words)).astype(bool)
            names.update(items)
        yield len(words), mask, names


def _all_but_last(rows: DataFrame, shared: list[Broadcast]) -> tuple[DataFrame, Broadcast | None, tuple[str, str] | None]:
    """``rows`` after every block but the last has marked them, the last, and the columns of marks."""
    if len(shared) < 2:
        return rows, shared[0] if shared else None, None
    names = tuple(unused(x, rows.columns) for x in ("hit_words", "hit_items"))
    plain = rows.columns
    marks = None
    for block in shared[:-1]:
        schema = StructType([*rows.select(*plain).schema.fields, StructField(names[0], BinaryType()), StructField(names[1], ArrayType(StringType()))])

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block, marks: tuple[str, str] | None = marks) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                got = list(_masks(block.value, batch, marks))
                packed = pa.array([np.packbits(m).tobytes() for _, m, _ in got], pa.binary())
                items = pa.array([sorted(x) for _, _, x in got], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), packed, items], names=[*plain, *names])

        rows, marks = materialize(rows.mapInArrow(run, schema), "decontam-marks"), names
    return rows, shared[-1], marks


def items_sha256(items: Column) -> Column:
    """SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
