"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Text is cut at white space, quotes and equals signs.  Maximal runs of adjoining pieces that hold a digit
or an at sign, lone separators between them included, are islands; everything else belongs to no entity.
A segment is up to ``REACH`` pieces of an island, its outer punctuation left out, and carries features of
the span as a whole: shape, digit count, check sum, separators, changes between letters and digits, the
word before it.  The best segmentation of an island is found by dynamic programming over all boundaries
and types at once; a segment has at most ``REACH`` pieces, so the work is linear in the pieces.

The weights are fitted by gradient ascent on the exact conditional likelihood, from islands of the whole
corpus that the fixed patterns (and for secrets, which have no fixed pattern, a strict rule: ``surely_secret``)
label, and from reformatted copies of them.  Of each label, the ``MAX_ISLANDS`` distinct islands with the
smallest hashes are taken.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import texts_of

#: Kinds of entities; the fixed patterns know all but the last.
KINDS = ("email", "ip", "card", "phone", "secret")
REACH = 8
#: Labelled islands of each kind, and of none, that the model is fitted on, at most.
MAX_ISLANDS = 400
#: Pieces of an island that the model is fitted on, at most; longer ones are only searched.
MAX_PIECES = 12
#: Characters before an island among which its cue, the last word, is looked for.
BEFORE = 24
#: An added span must beat the best reading without entities by so much (log odds).
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins at the first digit of its run: later digits of the run would fail in the same way
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
# an island begins where a piece begins, and no character is given back, so that long pieces take linear time
_ISLAND = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\s++(?:[^\s\w]{1,3}\s++)?+[^\s0-9@]*+[0-9@]\S*+)*+")
_PIECE = re.compile(r"[^\s='\"]+")
_SECRET = re.compile(r"[A-Za-z0-9_+/-]{16,}")
_TURN = re.compile(r"[0-9](?=[^\W\d_])|[^\W\d_](?=[0-9])")
_SECRET_CUES = ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential")
_OPENERS, _CLOSERS = "\"'<[{*_,;:!?.", "\"'>]}*_,;:!?.$%&#"
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, done, "email"))
        at = text.find("@", max(done, at + 1))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Island:
    """Adjoining pieces of a text, and the trimmed bounds of each segment of them."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, start, end)]
        before = re.findall(r"\w+", text[max(0, start - BEFORE) : start])
        self.cue = before[-1].lower()[:10] if before else ""

    def bounds(self, i: int, j: int) -> tuple[int, int]:
        start, end = self.pieces[i][0], self.pieces[j - 1][1]
        while start < end and self.text[start] in _OPENERS:
            start += 1
        while end > start and self.text[end - 1] in _CLOSERS:
            end -= 1
        return start, end

    def places(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Segments by their bounds."""
        n = len(self.pieces)
        return {self.bounds(i, j): (i, j) for i in range(n) for j in range(i + 1, min(n, i + REACH) + 1)}

    def cue_of(self, i: int) -> str:
        """The word before piece i: in the island if there is one, else before it."""
        if not i:
            return self.cue
        word = self.text[slice(*self.pieces[i - 1])]
        return word.lower()[:10] if word.isalpha() else "-"

    def features(self, i: int, j: int) -> list[str] | None:
        """Of the segment of pieces i to j - 1; None if it cannot be an entity."""
        start, end = self.bounds(i, j)
        span = self.text[start:end]
        if not 6 <= len(span) <= 160:
            return None
        digits = _NOT_DIGIT.sub("", span)
        turns = sum(1 for _ in _TURN.finditer(span))
        if len(digits) > 24 and not turns:
            return None
        shape = re.sub(r"[^\W\d_]+", "a", _DIGITS.sub("9", span))
        runs = re.sub(r"9+", lambda m: str(min(len(m[0]), 5)) if len(m[0]) < 5 else "N", shape)
        parts = span.split(".")
        octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        return [
            f"n{min(len(digits), 25)}",
            f"size{min(6, len(span) // 8)}",
            f"turns{min(4, turns // 3)}",
            f"solid{bool(_SECRET.fullmatch(span))}",
            f"long{min(4, len(digits) // 4)}",
            f"letters{bool(re.search(r'[^\W\d_]', span))}",
            f"at{min(2, span.count('@'))}",
            f"afterat{'@' in span and '.' in span.rpartition('@')[2]}",
            f"octets{octets}",
            f"luhn{12 <= len(digits) <= 19 and luhn(digits)}",
            f"plus{span[0] == '+'}",
            f"paren{'(' in span}",
            f"dots{min(4, span.count('.'))}",
            f"dash{min(4, span.count('-'))}",
            f"other{bool(re.search(r'[^\w\s.@()+-]', span))}",
            f"pieces{j - i}",
            f"runs{re.sub(r'[^0-9N]+', '.', runs)[:12]}" if "a" not in shape else "runsa",
            f"cue{(cue := self.cue_of(i))}",
            f"tells{cue.endswith(_SECRET_CUES)}",
            "bias",
        ]


def islands(text: str) -> Iterator[Island]:
    if "@" in text or _DIGITS.search(text):
        for m in _ISLAND.finditer(text):
            yield Island(text, m.start(), m.end())


class SemiMarkov:
    """Weights by (kind, feature); a piece outside any entity scores nothing."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def segments(self, island: Island) -> dict[tuple[int, int], list[str]]:
        n = len(island.pieces)
        return {(i, j): f for i in range(n) for j in range(i + 1, min(n, i + REACH) + 1) if (f := island.features(i, j))}

    def score(self, kind: str, found: list[str]) -> float:
        return sum(self.weights.get((kind, f), 0.0) for f in found)

    def decode(self, island: Island) -> list[tuple[int, int, str]]:
        """(first piece, end piece, kind) of the best segmentation whose entities each beat none by MARGIN."""
        n = len(island.pieces)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i in range(max(0, j - REACH), j):
                found = island.features(i, j)
                if found:
                    for kind in KINDS:
                        value = best[i] + self.score(kind, found) - MARGIN
                        if value > best[j]:
                            best[j], back[j] = value, (i, j, kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    @staticmethod
    def marginals(values: np.ndarray, spans: list[tuple[int, int]], n: int) -> np.ndarray:
        """Probability of each (segment, kind), by forward and backward sums over the boundaries."""
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        whole = np.logaddexp.reduce(values, axis=1)
        ending, starting = defaultdict(list), defaultdict(list)
        for k, (i, j) in enumerate(spans):
            ending[j].append((i, whole[k]))
            starting[i].append((j, whole[k]))
        for j in range(1, n + 1):
            ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + v for i, v in ending[j])]))
        for i in range(n - 1, -1, -1):
            behind[i] = float(np.logaddexp.reduce([behind[i + 1], *(behind[j] + v for j, v in starting[i])]))
        around = np.array([ahead[i] + behind[j] for i, j in spans])
        return np.exp(np.minimum(values + around[:, None] - ahead[n], 0.0))

    @staticmethod
    def fit(samples: list[tuple[Island, list]], rounds: int = 12, rate: float = 1.0, decay: float = 1e-4) -> SemiMarkov:
        """Stochastic gradient ascent on the conditional log-likelihood, steps scaled by feature."""
        place: dict[str, int] = {}
        prepared = []
        for island, gold in samples:
            found = SemiMarkov({}).segments(island)
            if found:
                spans = list(found)
                held = np.array([[place.setdefault(f, len(place)) for f in found[s]] for s in spans])
                truth = np.zeros((len(spans), len(KINDS)))
                for i, j, kind in gold:
                    if (i, j) in found:
                        truth[spans.index((i, j)), KINDS.index(kind)] = 1.0
                prepared.append((held, spans, len(island.pieces), truth))
        w = np.zeros((len(place), len(KINDS)))
        squares = np.full(w.shape, 1e-6)
        order = random.Random(3)
        for _ in range(rounds):
            order.shuffle(prepared)
            for held, spans, n, truth in prepared:
                off = truth - SemiMarkov.marginals(w[held].sum(axis=1), spans, n)
                slope = np.zeros_like(w[: held.max() + 1])
                np.add.at(slope, held.ravel(), np.repeat(off, held.shape[1], axis=0))
                some = np.unique(held)
                g = slope[some] - decay * w[some]
                squares[some] += g * g
                w[some] += rate * g / np.sqrt(squares[some])
        return SemiMarkov({(kind, f): float(w[i, k]) for f, i in place.items() for k, kind in enumerate(KINDS)})


def surely_secret(island: Island, i: int) -> bool:
    """Whether piece i is a long solid string of letters and digits in turn, and the word before it says so."""
    start, end = island.bounds(i, i + 1)
    span = island.text[start:end]
    return bool(_SECRET.fullmatch(span)) and sum(1 for _ in _TURN.finditer(span)) >= 6 and island.cue_of(i).endswith(_SECRET_CUES)


def labelled(island: Island, spans: list[Span]) -> list[tuple[int, int, str]] | None:
    """Spans of a text as segments of an island, and its sure secrets; None if a span of the island is not a segment."""
    place = island.places()
    lo, hi = island.pieces[0][0], island.pieces[-1][1]
    out = []
    for start, end, kind in spans:
        if lo <= start < hi:
            if (start, end) not in place:
                return None
            out.append((*place[start, end], kind))
    taken = {k for i, j, _ in out for k in range(i, j)}
    out += [(i, i + 1, "secret") for i in range(len(island.pieces)) if i not in taken and surely_secret(island, i)]
    return sorted(out)


def reformatted(island: Island, gold: list, rnd: random.Random) -> tuple[Island, list] | None:
    """A copy with its one entity written as the fixed patterns do not know it; None if that is no segment of it."""
    if len(gold) != 1:
        return None
    kind = gold[0][2]
    start, end = island.bounds(gold[0][0], gold[0][1])
    span = island.text[start:end]
    before = island.text[max(0, start - BEFORE) : start]
    if kind == "phone":
        plain = span.lstrip("+")
        new = rnd.choice([plain, re.sub(r"[ ().-]+", "-", plain), re.sub(r"[ ()-]+", ".", plain).strip("."), plain.replace(" ", "  "), plain.replace("-", " - ")])
    elif kind == "card":
        d = _NOT_DIGIT.sub("", span)
        new = rnd.choice([".", " - ", "  "]).join(d[i : i + 4] for i in range(0, len(d), 4))
    elif kind == "email":
        new = span.replace(".", "..", 1) if rnd.random() < 0.3 else span.lower()
    elif kind == "secret":
        letters = rnd.choice(["abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        new = rnd.choice(["sk-", "", ""]) + "".join(rnd.choice(rnd.choice(["0123456789", letters])) for _ in range(rnd.randrange(20, 64)))
        before = rnd.choice([before, "the ", "key: "])
    else:
        new = span
    text = before + new + island.text[end : end + 8]
    for other in islands(text):
        place = other.places().get((len(before), len(before) + len(new)))
        if place and len(other.pieces) == len(island.pieces) - (gold[0][1] - gold[0][0]) + place[1] - place[0]:
            return other, [(*place, kind)]
    return None


def _drawn(most: int):
    """Of each label, the islands of a task with the smallest hashes: label, at, text, lead, gold (flat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, tuple]] = defaultdict(dict)
        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                for text in texts:
                    for label, at, row in _labelled_islands(text) if text else ():
                        rows = held[label]
                        rows[at] = row
                        if len(rows) >= 4 * most:
                            held[label] = {k: rows[k] for k in sorted(rows)[:most]}
        out = [(label, at, *rows[at]) for label, rows in held.items() for at in sorted(rows)[:most]]
        if out:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["label", "at", "text", "lead", "gold"])

    return run


def _labelled_islands(text: str) -> Iterator[tuple[str, int, tuple]]:
    spans, nth = None, 0
    for island in islands(text):
        if len(island.pieces) > MAX_PIECES:
            continue
        if spans is None:
            spans = base_spans(text)
        lo, hi = island.pieces[0][0], island.pieces[-1][1]
        while nth < len(spans) and spans[nth][0] < lo:
            nth += 1
        end = bisect_left(spans, hi, nth, key=lambda s: s[0])
        gold = labelled(island, spans[nth:end])
        if gold is not None:
            first = max(0, lo - BEFORE)
            snippet = text[first : hi + 8]
            at = xxhash.xxh64_intdigest(snippet.encode("utf-8", "surrogatepass")) - (1 << 63)
            flat = [x for i, j, kind in gold for x in (i, j, KINDS.index(kind))]
            yield gold[0][2] if gold else "none", at, (snippet, lo - first, flat)


def fit(docs: DataFrame, most: int = MAX_ISLANDS) -> SemiMarkov:
    """Fit on at most ``most`` distinct islands of each label, by hash, out of all islands of all documents."""
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(_drawn(most), "label string, at long, text string, lead int, gold array<int>")
    order = Window.partitionBy("label").orderBy("at")
    few = rows.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= most).dropDuplicates(["label", "at"]).drop("nth").toPandas()
    rnd = random.Random(7)
    samples: list = []
    for row in few.sort_values(["label", "at"]).itertuples():
        found = [x for x in islands(row.text) if x.pieces[0][0] == row.lead]
        flat = list(row.gold)
        gold = [(i, j, KINDS[k]) for i, j, k in zip(flat[0::3], flat[1::3], flat[2::3])]
        if found and max((j for _, j, _ in gold), default=0) <= len(found[0].pieces):
            samples.append((found[0], gold))
            again = reformatted(found[0], gold, rnd) if gold else None
            if again:
                samples.append(again)
    return SemiMarkov.fit(samples)


def find(text: str | None, model: SemiMarkov | None) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed patterns, and all spans; added ones never touch those of the patterns."""
    if not text:
        return [], []
    base = base_spans(text)
    if model is None:
        return base, base
    added, nth = [], 0
    for island in islands(text):
        lo, hi = island.pieces[0][0], island.pieces[-1][1]
        while nth < len(base) and base[nth][1] <= lo:
            nth += 1
        near = [s for s in base[nth : bisect_left(base, hi, nth, key=lambda s: s[0])] if s[1] > lo]
        if len(near) == 1 and near[0][0] - lo <= 2 and hi - near[0][1] <= 2:
            continue  # the island is that one entity
        starts = [s[0] for s in near]
        reach = np.maximum.accumulate([s[1] for s in near]) if near else ()
        for i, j, kind in model.decode(island):
            start, end = island.bounds(i, j)
            before = bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                added.append((start, end, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


_COUNTS = [f"n_{kind}" for kind in KINDS[:4]]
_ROWS = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, base string, spans string, n_spans long"


def detect(docs: DataFrame, model: SemiMarkov | None) -> DataFrame:
    """doc_id; counts of the pattern spans by kind; base and spans: ``kind:start:end`` joined by commas; n_spans.

    base holds the pattern spans, spans these and the added ones, n_spans their number.  Places are code
    points, the end exclusive.  Null and empty texts have no spans and empty strings; whole texts are
    searched, however long, each row for itself.  Of segmentations with equal scores the one with fewer, then
    shorter, then earlier listed entities is taken.  No rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(1)):
                counts, joined, sizes = np.zeros((len(texts), 4), dtype=np.int64), ([], []), []
                for i, text in enumerate(texts):
                    found = find(text, model)
                    for s in found[0]:
                        counts[i, KINDS.index(s[2])] += 1
                    for out, spans in zip(joined, found):
                        out.append(",".join(f"{k}:{s}:{e}" for s, e, k in spans))
                    sizes.append(len(found[1]))
                arrays = [batch.column(0).slice(lo, len(texts)), *(pa.array(c) for c in counts.T), *(pa.array(x, pa.string()) for x in joined), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COUNTS, "base", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def masked(text: str | None, model: SemiMarkov | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by its first kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in find(text, model)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: SemiMarkov | None) -> DataFrame:
    """Docs with personal data masked in text, other columns unchanged, whatever their names; null stays null, rows that repeat stay alike."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(place)):
                part = batch.slice(lo, len(texts))
                columns = list(part.columns)
                columns[place] = pa.array([masked(t, model) for t in texts], part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
