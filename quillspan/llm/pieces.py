"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

White space is marked by U+2581, with one marker before the text.  No piece holds a marker after another
character, nor a line end, so the best segmentation of a text is that of its words one by one.  Words
that a task has not met are segmented together: the trie is walked from each place for all of them at
once in numpy.  A character that no piece covers falls back to the pieces of its bytes; a marker character
in the text itself does, too, so decoding gives back every text.

The public vocabulary at hand is a merge list whose scores are negative ranks.  Sums of ranks would prefer
spelling to long pieces, so ranks become log-probabilities by Zipf's law; a vocabulary with real log scores
is used as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose pieces a task keeps.
KEPT_WORDS = 200_000
_CHUNKS = re.compile(r" *[^ ]+| +")


class DoubleArray:
    """A trie of byte strings: child c of state s is base[s] + c + 1 where check there is s; value is an index or -1."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for index, key in enumerate(keys):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = index
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        value[0] = ends[0]
        starts: dict[int, int] = {}  # where the search for a place went on, by number of children
        work = [(0, 0)]
        while work:
            node, state = work.pop()
            codes = sorted(children[node])
            if not codes:
                continue
            at = max(starts.get(len(codes), 1), codes[0] + 1)
            while True:
                b = at - codes[0] - 1
                if b + 258 >= len(taken):
                    grow = len(taken)
                    taken += bytes(grow)
                    base, check, value = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
                if not any(taken[b + c + 1] for c in codes):
                    break
                at += 1
            starts[len(codes)] = at
            base[state] = b
            for c in codes:
                child = b + c + 1
                taken[child] = 1
                check[child], value[child] = state, ends[children[node][c]]
                work.append((children[node][c], child))
        self.base, self.check, self.value = (np.append(x, np.full(258, -1, np.int32)) for x in (base, check, value))


class Vocabulary:
    """Pieces with log scores, ids of bytes, and the trie."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], specials: list[int], penalty: float = 10.0):
        pieces = [(i, p, s) for i, p, s in pieces if p]
        if any(MARK in p.lstrip(MARK) or "\n" in p for _, p, _ in pieces):
            raise ValueError("a piece holds a marker within it, or a line end")
        self.ids = np.array([i for i, _, _ in pieces], dtype=np.int32)
        self.scores = np.array([s for _, _, s in pieces])
        self.trie = DoubleArray([p.encode() for _, p, _ in pieces])
        self.depth = max((len(p.encode()) for _, p, _ in pieces), default=1)
        self.fallback = float(self.scores.min() if len(pieces) else 0.0) - penalty
        self.byte_ids = byte_ids
        self.shown: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for i, p, _ in pieces}
        self.shown |= {i: bytes([b]) for b, i in enumerate(byte_ids)} | {i: b"" for i in specials}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """From a model file.  Scores that are all whole numbers are ranks and become -log(rank + 2.7), normed."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        specials = [i for i in range(n) if model.is_control(i) or model.is_unknown(i)]
        plain = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(n) if i not in set(specials) and not model.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        if all(float(s).is_integer() for _, _, s in plain):
            order = sorted(plain, key=lambda x: (-x[2], x[0]))
            norm = np.log((1 / (np.arange(len(order)) + 2.7)).sum())
            plain = [(i, p, float(-np.log(r + 2.7) - norm)) for r, (i, p, _) in enumerate(order)]
        return Vocabulary(sorted(plain), [byte_ids[b] for b in range(256)], specials)

    def _viterbi(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of each word, for words of like length."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width).astype(np.int32)
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((len(words), width + 1), dtype=np.int32)
        piece = np.full((len(words), width + 1), -1, dtype=np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            lead = text[rows, i]
            n = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            to, total = i + n, best[rows, i] + self.fallback * n
            better = total > best[rows, to]
            r, to = rows[better], to[better]
            best[r, to], came[r, to], piece[r, to] = total[better], n[better], -1
            state = np.zeros(len(rows), dtype=np.int32)
            for d in range(min(self.depth, width - i)):
                alive = size[rows] > i + d
                rows, state = rows[alive], state[alive]
                following = base[state] + text[rows, i + d] + 1
                alive = check[following] == state
                rows, state = rows[alive], following[alive]
                if not len(rows):
                    break
                found = value[state]
                ends = found >= 0
                r, total = rows[ends], best[rows[ends], i] + self.scores[found[ends]]
                better = total > best[r, i + d + 1]
                r = r[better]
                best[r, i + d + 1], came[r, i + d + 1], piece[r, i + d + 1] = total[better], d + 1, found[ends][better]
        out = []
        came, piece, ids, byte_ids = came.tolist(), piece.tolist(), self.ids.tolist(), self.byte_ids
        for w, n, back, what in zip(words, size.tolist(), came, piece):
            got: list[int] = []
            while n:
                if what[n] >= 0:
                    got.append(ids[what[n]])
                else:
                    got += [byte_ids[b] for b in w[n - back[n] : n][::-1]]
                n -= back[n]
            out.append(np.array(got[::-1], dtype=np.int32).tobytes())
        return out

    def _long(self, word: bytes) -> bytes:
        """The same for one word of any length."""
        n = len(word)
        best, came, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        if not hasattr(self, "_lists"):
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores)]
        base, check, value, scores = self._lists
        for i in range(n):
            if best[i] == -np.inf:
                continue
            lead = word[i]
            k = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            if (total := best[i] + self.fallback * k) > best[i + k]:
                best[i + k], came[i + k], piece[i + k] = total, k, -1
            state = 0
            for j in range(i, min(n, i + self.depth)):
                following = base[state] + word[j] + 1
                if check[following] != state:
                    break
                state = following
                if value[state] >= 0 and (total := best[i] + scores[value[state]]) > best[j + 1]:
                    best[j + 1], came[j + 1], piece[j + 1] = total, j + 1 - i, value[state]
        got = []
        while n:
            if piece[n] >= 0:
                got.append(int(self.ids[piece[n]]))
            else:
                got += [self.byte_ids[b] for b in word[n - came[n] : n][::-1]]
            n -= came[n]
        return np.array(got[::-1], dtype=np.int32).tobytes()

    def _word_ids(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of words: a key is a word that follows a marker, or a line end and what follows it."""
        todo, plans = {}, {}
        for key in keys:
            parts = key[1:].split(MARK) if key[:1] == "\n" else key.split(MARK)
            plan = [p.replace(" ", MARK) if i or key[:1] == "\n" else MARK + p.replace(" ", MARK) for i, p in enumerate(parts)]
            plans[key] = plan
            todo.update((p, b"") for p in plan if p)
        order = sorted((p.encode() for p in todo), key=len)
        lo = 0
        while lo < len(order):
            if len(order[lo]) > 64:
                todo.update((w.decode(), self._long(w)) for w in order[lo:])
                break
            hi = lo
            while hi < len(order) and hi - lo < 8192 and len(order[hi]) <= min(64, len(order[lo]) + 4):
                hi += 1
            todo.update(zip((w.decode() for w in order[lo:hi]), self._viterbi(order[lo:hi])))
            lo = hi
        mark = np.array([self.byte_ids[b] for b in MARK.encode()], dtype=np.int32).tobytes()
        line = np.array([self.byte_ids[10]], dtype=np.int32).tobytes()
        return {key: (line if key[:1] == "\n" else b"") + mark.join(todo[p] if p else b"" for p in plan) for key, plan in plans.items()}

    def encode(self, texts: list) -> list[bytes | None]:
        """Ids of each text as int32 bytes; None for None."""
        keyed: list[list[str] | None] = []
        for text in texts:
            if text is None:
                keyed.append(None)
                continue
            keys: list[str] = []
            for nth, line in enumerate(text.split("\n") if text else ()):
                shown = line if nth else " " + line
                if "  " in shown:
                    bits = _CHUNKS.findall(shown)
                    if nth and (not bits or bits[0][0] != " "):
                        bits = ["\n" + (bits[0] if bits else ""), *(b[1:] for b in bits[1:])]
                    else:
                        bits = ["\n"] * bool(nth) + [b[1:] for b in bits]
                    keys += bits
                elif nth:
                    bits = line.split(" ")
                    bits[0] = "\n" + bits[0]
                    keys += bits
                else:
                    keys += line.split(" ")
            keyed.append(keys)
        known = self.known
        new = {k for keys in keyed if keys for k in keys if k not in known}
        if new:
            fresh = self._word_ids(list(new))
            if len(known) < KEPT_WORDS:
                known.update((k, v) for k, v in fresh.items() if len(k) <= 64)
            look = {**fresh}
            get = lambda k: known[k] if k in known else look[k]
            return [None if keys is None else b"".join(map(get, keys)) for keys in keyed]
        return [None if keys is None else b"".join(map(known.__getitem__, keys)) for keys in keyed]

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: bytes joined, markers shown as spaces, the first one left out; None for None."""
        if ids is None:
            return None
        raw = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


def _shared(df: DataFrame, vocabulary: Vocabulary):
    vocabulary.known = {}
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """Columns of docs but text and ids, with ids (array<int>), and with ``decoded`` also text decoded from them.

    Whole texts are encoded, however long, each row for itself.  A null text has null ids, an empty one no ids.
    Of segmentations with equal scores the one whose last pieces are longer is taken.  No rows give no rows.
    """
    held = _shared(docs, vocabulary)
    names = [c for c in docs.columns if c not in ("text", "ids")]
    rows = docs.select(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        for batch in batches:
            for lo, texts in texts_of(batch.column(len(names)), 256):
                found = voc.encode(texts)
                ends = np.cumsum([0] + [len(x) // 4 if x else 0 for x in found])
                flat = np.frombuffer(b"".join(x for x in found if x), dtype=np.int32)
                nulls = pa.array([x is None for x in found])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=nulls)
                part = batch.slice(lo, len(texts))
                columns, titles = [*part.columns[:-1], ids], [*names, "ids"]
                if decoded:
                    as_list = flat.tolist()
                    columns.append(pa.array([None if x is None else voc.decode(as_list[a:b]) for x, a, b in zip(found, ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
                    titles.append("text")
                yield pa.RecordBatch.from_arrays(columns, titles)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["ids array<int>"] + ["text string"] * decoded
    return rows.mapInArrow(run, ", ".join(fields))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Columns of encoded but ids and text, with the text of ids.  Null ids have a null text; unknown ids fail."""
    held = _shared(encoded, vocabulary)
    names = [c for c in encoded.columns if c not in ("text", "ids")]
    rows = encoded.select(*names, F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([held.value.decode(x) for x in part.columns[-1].to_pylist()], pa.string())], [*names, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string"]
    return rows.mapInArrow(run, ", ".join(fields))
