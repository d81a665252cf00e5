"""Toxicity: a support vector machine with a gapped subsequence kernel over Nyström landmarks.

Units. A sentence is read as its words, each folded to letters (lower case, look-alike digits
and signs read as letters, other signs inside a word dropped); runs of single letters are also
read joined. A unit is one such word between two boundary marks.

Kernel. Two units share a subsequence of three symbols for each way to pick them, in order,
from a span of at most ``SPAN`` symbols; a way whose span exceeds three by g counts
``DECAY**g``; values are divided by a length norm. So inserted characters weaken a match but
do not break it.

Landmarks. ``LANDMARKS`` units stand for the feature space: K(., L) K(L, L)^(-1/2).

Training. Labels come per document. Its units inherit the label, and as most units of a toxic
document are harmless, the machine and the units it calls toxic are found in turns (multiple
instance learning), beginning with units, or stems of units, that explain the toxic documents
and hardly occur in others.
The labelled sample is bounded by ``MAX_TOXIC`` and ``MAX_CLEAN`` documents.

Scoring. The decision is linear in subsequence counts, so it folds into one weight for each
of the subsequences: that table is broadcast. A document's score is the logistic of its
highest unit decision, placed by the bound that parts the sample's documents best; beyond the
margin it is level.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, crc_remainder, keep_rows, labelled_texts, map_texts

# Settings hold up in cross-validation within the folds whose labels may be learned.
MAX_TOXIC = 1500
MAX_CLEAN = 3000
#: Units without the label to begin with, by hash.
NEGATIVE_UNITS = 10_000
HARD_UNITS = 4_000
HARD_LANDMARKS = 60
LANDMARKS = 240
SPAN = 6
DECAY = 0.6
ROUNDS = 4
#: Letters of a stem, and how much more frequent in toxic documents a candidate must be.
STEM_LETTERS = (4, 10)
LIFT = 25
#: A unit with a letter put in counts this many times less than the unit.
GAPPED_PARTS = 8
THRESHOLD = 0.7
BOUND_PLACE = 0.75
LEAST_GAP = 0.1
CACHE_UNITS = 150_000

#: a to z, the edge, and classes of other letters by code point.
_OTHERS = 11
_EDGE, _SYMBOLS = 27, 28 + _OTHERS
FEATURES = _SYMBOLS**3
#: Characters read as letters inside a word that has letters.
_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){3,}[^\W\d_](?!\S)")


def fold(word: str) -> str:
    """Letters of one word, in composed form and lower case."""
    word = word.lower()
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    if any(c.isalpha() for c in word):
        word = word.translate(_ALIKE)
    return "".join(filter(str.isalpha, word))


def raw_units(text: str) -> set[str]:
    """Distinct raw words of a text, and its runs of single letters joined."""
    units = set(text.split())
    for m in _SPELLED.finditer(text):
        units.add("".join(m[0].split()))
    return units


def _symbols(word: str) -> list[int]:
    return [_EDGE, *(ord(c) - 96 if "a" <= c <= "z" else _EDGE + 1 + ord(c) % _OTHERS for c in word), _EDGE]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words at once: the word, feature and weight of each pick of three symbols."""
    coded = [_symbols(w) for w in words]
    sizes = np.array([len(c) for c in coded], np.int64)
    flat = np.fromiter((x for c in coded for x in c), np.int64, int(sizes.sum()))
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    which, code, weight = [], [], []
    for b in range(2, SPAN):
        i = np.flatnonzero(left > b)
        for a in range(1, b):
            which.append(word[i])
            code.append((flat[i] * _SYMBOLS + flat[i + a]) * _SYMBOLS + flat[i + b])
            weight.append(np.full(len(i), DECAY ** (b - 2)))
    if not which:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return np.concatenate(which), np.concatenate(code), np.concatenate(weight)


def _norms(words: list[str]) -> np.ndarray:
    """Length norm of each word: the root of the sum of its picks' squared weights."""
    n = np.array([len(w) + 2 for w in words], float)
    square = sum((b - 1) * DECAY ** (2 * (b - 2)) * np.maximum(n - b, 0) for b in range(2, SPAN))
    return np.sqrt(np.maximum(square, 1))


@dataclass
class Model:
    #: Weight of each subsequence; nothing if no labels were known.
    weight: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    unknown: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision of each folded word."""
        out = np.zeros(len(words))
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            which, code, weight = subsequences(part)
            total = np.bincount(which, weights=weight * self.weight[code], minlength=len(part))
            out[at : at + len(part)] = total / _norms(part) + self.bias
        return out

    def learn(self, raw: list[str]) -> None:
        for at in range(0, len(raw), 10_000):
            part = raw[at : at + 10_000]
            self.known.update(zip(part, self.decide([fold(w) for w in part]).tolist(), strict=True))

    def highest(self, texts: list[str]) -> np.ndarray:
        """Highest unit decision of each text; that of the empty word if there is none."""
        sets = [raw_units(t) for t in texts]
        known = self.known
        if len(known) > CACHE_UNITS:
            known.clear()
        need = set().union(*sets) - known.keys() if sets else set()
        self.learn([*need, *({""} - known.keys())])
        nothing = known[""]
        return np.array([max(map(known.__getitem__, s), default=nothing) for s in sets])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.unknown)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(self.highest(texts), 1) + self.shift, -30, 30)))


def _features(words: list[str], table: np.ndarray) -> np.ndarray:
    """Rows of normed counts times ``table``, in blocks."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for at in range(0, len(words), 100):
        part = words[at : at + 100]
        which, code, weight = subsequences(part)
        order = np.argsort(which, kind="stable")
        which, code, weight = which[order], code[order], weight[order]
        starts = np.searchsorted(which, np.arange(len(part)))
        rows = np.add.reduceat(table[code] * weight[:, None].astype(np.float32), np.minimum(starts, len(code) - 1), axis=0)
        out[at : at + len(part)] = np.where((np.bincount(which, minlength=len(part)) > 0)[:, None], rows, 0)
    out /= _norms(words)[:, None]
    return out


def _dense(words: list[str]) -> np.ndarray:
    table = np.zeros((FEATURES, len(words)), np.float32)
    which, code, weight = subsequences(words)
    np.add.at(table, (code, which), weight)
    table /= _norms(words).astype(np.float32)
    return table


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last entry is the bias."""
    x = np.c_[z, np.ones(len(z), np.float32)]
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ w) < 1
        near = x[active]
        scaled = near * weight[active, None].astype(np.float32)
        step = np.linalg.solve(ridge + 2 * c * (near.T @ scaled).astype(float), 2 * c * (scaled.T @ y[active]))
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


def _calibrated(best: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score's logistic, by documents' highest decisions and labels.

    The bound is the decision that tells the labels apart with the least share of errors, at
    ``BOUND_PLACE`` of the way across the gap it lies in; it scores ``THRESHOLD``. The far edge
    of the gap scores 0.95, or, if it is narrow, a decision ``LEAST_GAP`` beyond the bound.
    """
    order = np.argsort(best, kind="stable")
    d, y = best[order], y[order]
    pos, neg = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    # Errors if the bound lies before place i: label 1 below it, label 0 from it on.
    lost = np.r_[0, np.cumsum(y)] / pos
    false = (neg - np.r_[0, np.cumsum(1 - y)]) / neg
    least = lost + false
    least[:-1][np.r_[False, d[1:] == d[:-1]]] = np.inf
    i = int(len(least) - 1 - np.argmin(least[::-1]))
    low = d[i - 1] if i else d[0] - 1
    high = d[i] if i < len(d) else d[-1] + 1
    bound = low + BOUND_PLACE * (high - low)
    at = np.log(THRESHOLD / (1 - THRESHOLD))
    slope = (np.log(0.95 / 0.05) - at) / max(high - bound, LEAST_GAP)
    return float(slope), float(at - slope * bound)


def _landmarks(toxic: list[str], hard: list[str], clean: list[str]) -> list[str]:
    """Half of them toxic units, common ones first; then harmless ones that look toxic; then any."""
    half = LANDMARKS // 2
    # A stem's units are alike: part of the landmarks spread over the list.
    step = max(1, len(toxic) // half)
    marks = dict.fromkeys(toxic[: half // 2] + toxic[half // 2 :: step][: half - half // 2])
    marks.update(dict.fromkeys(hard[:half]))
    marks.update(dict.fromkeys(clean[:half]))
    return list(marks)[:LANDMARKS]


def _nystroem(marks: list[str]) -> np.ndarray:
    """Weights that turn subsequence counts into coordinates: the landmarks' table times K(L, L)^(-1/2)."""
    table = _dense(marks)
    val, vec = np.linalg.eigh((table.T @ table).astype(float))
    keep = val > 1e-5 * val[-1]
    return table @ (vec[:, keep] / np.sqrt(val[keep])).astype(np.float32)


def train(bags: list[tuple[int, list[str]]], unknown: float = 0.0) -> Model:
    """Fit on (label, distinct folded units) of documents."""
    bags = [(y, units) for y, units in bags if units]
    pos, neg = [u for y, u in bags if y], [u for y, u in bags if not y]
    if not pos or not neg:
        return Model(unknown=unknown)
    clean = set().union(*neg)
    toxic = _explaining(pos, neg)
    if not toxic:
        return Model(unknown=unknown)
    clean -= toxic.keys()
    by_hash = sorted(clean, key=lambda u: (crc32(u.encode()), u))
    harmless = by_hash[:NEGATIVE_UNITS]
    rest = by_hash[NEGATIVE_UNITS:]
    # Letters are put only into insults that are common and whose beginning no harmless unit has.
    begun, top = {u[: STEM_LETTERS[0]] for u in clean}, max(toxic.values())
    common = sorted(u for u, n in toxic.items() if 4 * n >= top and u[: STEM_LETTERS[0]] not in begun)
    hard: list[str] = []
    model = Model(unknown=unknown)
    for turn in range(ROUNDS):
        mapped = _nystroem(_landmarks(list(toxic), hard, by_hash))
        good, bad = sorted(toxic), sorted(set(harmless) - toxic.keys())
        gapped = [(g, toxic[u] / GAPPED_PARTS) for u in common for g in _gapped(u) if g not in clean]
        words = good + [g for g, _ in gapped] + bad
        positive = len(words) - len(bad)
        y = np.r_[np.ones(positive), -np.ones(len(bad))]
        size = np.r_[np.sqrt([toxic[u] for u in good] + [n for _, n in gapped]), np.ones(len(bad))]
        size[:positive] *= len(bad) / size[:positive].sum()
        w = _svm(_features(words, mapped), y, size)
        model.weight, model.bias = (mapped @ w[:-1]).astype(float), float(w[-1])
        if turn == ROUNDS - 1:
            break
        # Harmless units that look toxic join the sample; toxic documents name further units.
        decided = model.decide(rest) if rest else np.zeros(0)
        near = model.decide(harmless)
        hard = [harmless[i] for i in np.argsort(-near)[:HARD_LANDMARKS] if near[i] > -0.9]
        hard += [rest[i] for i in np.argsort(-decided)[:HARD_LANDMARKS] if decided[i] > -0.5]
        harmless = sorted({*harmless, *(rest[i] for i in np.argsort(-decided)[:HARD_UNITS] if decided[i] > -1)})
        for units in pos:
            mine = [u for u in units if u not in clean and u not in toxic]
            if mine:
                d = model.decide(mine)
                at = int(d.argmax())
                if d[at] > (0 if toxic.keys().isdisjoint(units) else 0.8):
                    toxic[mine[at]] = 1
    best = np.array([model.decide(u).max() for _, u in bags])
    model.known = {}
    model.slope, model.shift = _calibrated(np.minimum(best, 1), np.array([y for y, _ in bags], float))
    return model


def _gapped(unit: str) -> list[str]:
    """The unit with one letter put in: at two inner places, chosen by hash."""
    if len(unit) < 4:
        return []
    h = crc32(unit.encode())
    places = {1 + h % (len(unit) - 1), 1 + (h >> 8) % (len(unit) - 1)}
    return [unit[:i] + chr(97 + (h >> 16) % 26) + unit[i:] for i in sorted(places)]


def _stems(unit: str) -> list[str]:
    """Beginnings of a unit, and the unit itself with a closing mark."""
    return [*(unit[:k] for k in range(STEM_LETTERS[0], min(len(unit), STEM_LETTERS[1]) + 1)), unit + "$"]


def _explaining(pos: list[list[str]], neg: list[list[str]]) -> dict[str, int]:
    """Units that together explain the toxic documents, with how many hold each, most first.

    Candidates are units and stems that are ``LIFT`` times as frequent in toxic documents as in
    others. Greedy cover: each time the candidate that the most documents not yet explained
    share. So the words that copies of one document share are not mistaken for insults: the
    copies are explained by the insult that other documents have too. Documents that share
    no candidate with another stay unexplained here.
    """
    least = min(3, 1 + len(pos) // 20)
    hashes = [np.fromiter({crc32(s.encode()) for u in units for s in _stems(u)}, np.uint32) for units in pos]
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    often = set(values[counts >= least].tolist())
    del hashes, values, counts
    where: dict[str, list[int]] = {}
    for i, units in enumerate(pos):
        for s in {s for u in units for s in _stems(u)}:
            if crc32(s.encode()) in often:
                where.setdefault(s, []).append(i)
    elsewhere: dict[str, int] = {}
    for units in neg:
        for s in {s for u in units for s in _stems(u) if s in where}:
            elsewhere[s] = elsewhere.get(s, 0) + 1
    share = len(neg) / len(pos)
    where = {s: at for s, at in where.items() if len(at) * share >= LIFT * (elsewhere.get(s, 0) + 0.5)}
    heap = [(-len(at), -len(s), s) for s, at in where.items()]
    heapq.heapify(heap)
    left, chosen = np.ones(len(pos), bool), {}
    while heap and left.any():
        n, size, s = heapq.heappop(heap)
        now = int(left[where[s]].sum())
        if now != -n:
            if now >= least:
                heapq.heappush(heap, (-now, size, s))
            continue
        chosen[s] = len(where[s])
        left[where[s]] = False
    # What comes with others all the time explains nothing more, but is as common.
    common = max(3, max(chosen.values(), default=0) // 8)
    chosen.update((s, len(at)) for s, at in where.items() if len(at) >= common)
    out: dict[str, int] = {}
    for units in pos:
        for u in units:
            if any(s in chosen for s in _stems(u)):
                out[u] = out.get(u, 0) + 1
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, held: int = 1, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN, unknown: float = 0.0) -> Model:
    """Fit on a bounded number of labelled documents of each class outside the held-out fold, by hash.

    Units are read on executors; all distinct units of each document come back, so training and
    the bound's place see whole texts, as scoring does.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", mod) != held))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    rows = labelled_texts(docs, known, ("label = 1", most_toxic), ("label = 0", most_clean))

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            units = []
            for text in as_texts(batch.column("text")):
                folded = {fold(u) for u in raw_units(text)} - {""}
                units.append(" ".join(sorted(folded, key=lambda u: (crc32(u.encode()), u))))
            return {"label": batch.column("label"), "units": units}

        return kernel

    got = map_texts(rows, make, "label int, units string").toArrow()
    bags, one = [], {}
    for y, units in sorted(zip(got.column("label").to_pylist(), got.column("units").to_pylist(), strict=True)):
        # One string object for all occurrences of a unit.
        bags.append((y, [one.setdefault(u, u) for u in units.split(" ") if u]))
    del got, one
    return train(bags, unknown)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; null and empty texts score as the empty word does.

    Equal texts score alike, repeated rows give repeated rows (also without a doc_id), an empty
    table none. Texts are read whole; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = replace(shared.value, known={})

        def kernel(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "score": own.scores(as_texts(batch.column("text")))}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id bigint, score double")


def clean_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score stays below the threshold, with all their columns, whatever these are called.

    Rows are judged as ``scored`` judges them, repeated ones each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = replace(shared.value, known={})
        return lambda batch: (own.scores(as_texts(batch.column("text"))) < threshold).tolist()

    return keep_rows(docs, make)
