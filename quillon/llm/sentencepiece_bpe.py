"""Exact merge-type (BPE) encoding by backtracking, and decoding.

A piece sequence is what merging would give if each piece merges to itself and
each two neighbours, merged again from their characters, come out as the same
two pieces. So an encoder need not merge a text: from the left it takes the
longest piece (an Aho-Corasick automaton over the pieces finds it), goes to
shorter ones while the piece isn't compatible with the one before, and steps
back if none is; a bitfield of positions from which nothing can be reached
keeps it linear.

No piece has the space mark behind another character, so a text falls into
independent chunks: the marks before a word and the word. Chunks' results are
kept in a bounded table by 128 bits of hash, as are the answers about neighbours;
a block of texts looks its chunks up as arrays. Chunks that are new
go through the automaton together, and those whose longest matches don't fit step
forth and back together, as numpy arrays with a row each. Long chunks and those
with unknown characters go one by one: such a chunk falls into parts between
characters that no piece has side by side, and characters that no piece has at
all become bytes.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, give_back
from .textgrams import run_keys

MARK = "▁"
#: Chunks and pairs that a worker remembers; beyond that it begins anew.
REMEMBERED = 500_000
#: Characters of texts that are encoded at once, about.
BLOCK = 1 << 17
#: Longer chunks are encoded one by one.
SHORT = 48


class Table:
    """Whole numbers by 128-bit keys in an open hash table; keys and numbers come and go as arrays."""

    def __init__(self):
        self.clear()

    def clear(self, slots: int = 1 << 16) -> None:
        self.a, self.b, self.value, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1), 0

    def _first(self, a: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.a).bit_length())).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 of unknown ones."""
        out, todo, at = np.full(len(a), -1), np.arange(len(a)), self._first(a)
        while len(todo):
            value = self.value[at]
            hit = (value >= 0) & (self.a[at] == a[todo]) & (self.b[at] == b[todo])
            out[todo[hit]] = value[hit]
            on = ~hit & (value >= 0)
            todo, at = todo[on], (at[on] + 1) % len(self.a)
        return out

    def put(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        """Add new, different keys with numbers from 0 on."""
        if 2 * (self.n + len(a)) > len(self.a):
            there = self.value >= 0
            old = self.a[there], self.b[there], self.value[there]
            self.clear(1 << (3 * (len(old[0]) + len(a))).bit_length())
            self._fill(*old)
        self._fill(a, b, value)

    def _fill(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.n += len(a)
        at = self._first(a)
        while len(a):
            free = self.value[at] < 0
            # Of keys that meet at a free place one is written; the others go on.
            self.a[at[free]], self.b[at[free]], self.value[at[free]] = a[free], b[free], value[free]
            on = ~((self.a[at] == a) & (self.b[at] == b))
            a, b, value, at = a[on], b[on], value[on], (at[on] + 1) % len(self.a)


class Encoder:
    def __init__(self, model_file: str):
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(self.piece))]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has the space mark inside")
        known = {p for p in self.id if len(p) == 1}
        if any(not known.issuperset(p) for p in self.id):
            raise ValueError("a piece has a character that is no piece")
        self.known = known
        # Neighbours within some piece; between all others a text falls apart.
        self.inside = {p[k - 1 : k + 1] for p in self.id for k in range(1, len(p))}
        sound = [p for p in self.id if self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in sound:
            self.automaton.add_word(p, self.id[p])
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.piece]
        self.longest = max(map(len, sound))
        self.text = [str(i) for i in range(len(self.piece))]
        ids = {p: self.id[p] for p in sound}
        # The next shorter piece that a piece begins with, -1: none.
        self.shorter = [-1] * len(self.piece)
        for p, i in ids.items():
            self.shorter[i] = next((ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in ids), -1)
        self.fits = Remembered(self._fits, REMEMBERED // 8)
        self.part = Remembered(self._part, REMEMBERED // 16)
        self.lengths, self.shorters = np.array(self.length), np.array(self.shorter)
        self.pairs, self.chunks = Table(), Table()
        # Token ids of all chunks, one after another, and where each begins.
        self.pool, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def merge(self, text: str) -> list[str]:
        """What merging from characters gives: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: tuple[int, int]) -> bool:
        a, b = self.piece[pair[0]], self.piece[pair[1]]
        return self.merge(a + b) == [a, b]

    def _run(self, text: str) -> list[int]:
        """Encode a run of known characters."""
        fits, length, longest = self.fits, self.length, self.automaton.iter_long
        out = [i for _, i in longest(text)]
        for k in range(1, len(out)):
            if not fits[out[k - 1], out[k]]:
                break
        else:
            return out
        # The longest matches up to here fit; go on from the first that doesn't.
        token, shorter, n, reach = out[k], self.shorter, len(text), self.longest
        del out[k:]
        at = sum([length[i] for i in out])
        open_ = bytearray(b"\1") * (n + 1)  # positions from which nothing has failed yet
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_[at + length[token]] and (last < 0 or fits[last, token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                # No match is longer than `reach`, so a step costs the same however long the run is.
                token = next(longest(text[at : at + reach]))[1] if at < n else -1
            elif last < 0:
                raise ValueError("no encoding found")
            else:
                open_[at] = 0
                out.pop()
                at -= length[last]
                token = last
        return out

    def _part(self, text: str) -> tuple[int, ...]:
        return tuple(self._run(text) if text[0] in self.known else [self.byte[b] for b in text.encode()])

    def _chunk(self, word: str) -> tuple[int, ...]:
        text, inside = MARK + word, self.inside
        pairs = list(map(add, text, text[1:]))
        if inside.issuperset(pairs):
            return self._part(text)
        cuts = [k for k, pair in enumerate(pairs, 1) if pair not in inside]
        return tuple(chain.from_iterable([self.part[text[i:k]] for i, k in zip([0, *cuts], [*cuts, len(text)])]))

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two pieces fit side by side."""
        key, b = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), np.zeros(len(a), np.uint64)
        got = self.pairs.find(key, b)
        if (got < 0).any():
            new = np.unique(key[got < 0])
            if self.pairs.n + len(new) > max(REMEMBERED, 2 * len(new)):
                self.pairs.clear()
            fits = [self._fits((k >> 32, k & 0xFFFFFFFF)) for k in new.tolist()]
            self.pairs.put(new, np.zeros(len(new), np.uint64), np.array(fits, np.int64))
            left = np.flatnonzero(got < 0)
            got[left] = np.array(fits, np.int64)[np.searchsorted(new, key[left])]
        return got > 0

    def _together(self, words: list[str], got: dict[str, list[int]]) -> None:
        """Encode chunks, without their first mark, of known characters, none of which ends in a mark."""
        text = MARK + MARK.join(words)
        ids = np.array([i for _, i in self.automaton.iter_long(text)])
        size = np.array([len(w) + 1 for w in words])
        base = np.cumsum(size) - size
        begin = np.searchsorted(np.cumsum(self.lengths[ids]) - self.lengths[ids], base)
        inner = np.ones(len(ids), bool)
        inner[begin] = False
        second = np.flatnonzero(inner)
        misfit = second[~self._fit(ids[second - 1], ids[second])]
        wrong = np.zeros(len(words), bool)
        wrong[np.searchsorted(begin, misfit, "right") - 1] = True
        flat, cuts = ids.tolist(), [*begin.tolist(), len(ids)]
        for k in np.flatnonzero(~wrong).tolist():
            got[words[k]] = flat[cuts[k] : cuts[k + 1]]
        if wrong.any():
            self._stepwise([words[k] for k in np.flatnonzero(wrong).tolist()], size[wrong], got)

    def _stepwise(self, words: list[str], size: np.ndarray, got: dict[str, list[int]]) -> None:
        """As _run, for all of the words together."""
        text, lengths = MARK + MARK.join(words), self.lengths
        base = np.cumsum(size) - size
        ends, ids = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2).T
        order = np.argsort(lengths[ids], kind="stable")  # the longest from each place is written last
        longest = np.full(len(text), -1)
        longest[(ends - lengths[ids] + 1)[order]] = ids[order]
        out = np.zeros((len(words), int(size.max())), np.int64)
        open_ = np.ones((len(words), int(size.max()) + 1), bool)
        at, depth, token = np.zeros_like(size), np.zeros_like(size), longest[base]
        live = np.arange(len(words))
        while len(live):
            t, d = token[live], depth[live]
            some = t >= 0
            last, to = np.where(d > 0, out[live, d - 1], -1), at[live] + lengths[t]
            good = some & open_[live, np.where(some, to, 0)]
            asked = np.flatnonzero(good & (last >= 0))
            good[asked] = self._fit(last[asked], t[asked])
            w = live[good]
            out[w, depth[w]] = t[good]
            at[w] = to[good]
            depth[w] += 1
            token[w] = longest[base[w] + np.minimum(at[w], size[w] - 1)]
            no = some & ~good
            token[live[no]] = self.shorters[t[no]]
            back = live[~some]
            if len(back):
                if not depth[back].all():
                    raise ValueError("no encoding found")
                open_[back, at[back]] = False
                depth[back] -= 1
                token[back] = out[back, depth[back]]
                at[back] -= lengths[token[back]]
            live = live[at[live] < size[live]]
        for word, row, n in zip(words, out.tolist(), depth.tolist()):
            got[word] = row[:n]

    def _learn(self, words: list[str]) -> list[list[int]]:
        """The ids of chunks, given without their first mark."""
        known, got = self.known.issuperset, {}
        together = [w for w in words if 0 < len(w) <= SHORT and w[-1] != MARK and known(w)]
        if together:
            self._together(together, got)
        return [got[w] if w in got else self._chunk(w) for w in words]

    def _numbers(self, a: np.ndarray, b: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """The numbers in the pool of different chunks, given by their keys."""
        found = self.chunks.find(a, b)
        new = np.flatnonzero(found < 0)
        if len(new) and self.chunks.n + len(new) > max(REMEMBERED, len(a)):
            self.chunks.clear()
            self.pool, self.begin = self.pool[:0], self.begin[:1]
            new = np.arange(len(a))
        if len(new):
            ids = self._learn([word(k) for k in new.tolist()])
            found[new] = np.arange(len(new)) + len(self.begin) - 1
            self.chunks.put(a[new], b[new], found[new])
            ends = self.begin[-1] + np.cumsum([len(i) for i in ids])
            self.begin = np.concatenate((self.begin, ends))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1] - len(self.pool)))
            self.pool = np.concatenate((self.pool, flat))
        return found

    def _block(self, texts: list[str]) -> list[list[int]]:
        parts = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        text, size = "".join(parts), np.array([len(p) for p in parts])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(size) - size
        first = codes == ord(MARK)
        first[1:] &= ~first[:-1]
        first[starts[size > 0]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(codes))
        a, b = run_keys(codes, begin, end)
        _, at, back = np.unique(a, return_index=True, return_inverse=True)
        if (b[at][back] != b).any():  # two chunks with one first hash: look at each place
            at = back = np.arange(len(a))
            ids = self._learn([text[i + 1 : k] for i, k in zip(begin.tolist(), end.tolist())])
            flat, count = np.array(list(chain.from_iterable(ids)), np.int64), np.array([len(i) for i in ids])
        else:
            number = self._numbers(a[at], b[at], lambda k: text[begin[at[k]] + 1 : end[at[k]]])[back]
            count = self.begin[number + 1] - self.begin[number]
            flat = self.pool[np.repeat(self.begin[number] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        cuts = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begin, np.append(starts, len(codes)))].tolist()
        flat = flat.tolist()
        return [flat[i:k] for i, k in zip(cuts, cuts[1:])]

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, without begin or end ids."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    """One encoder for each worker process and model."""
    return Encoder(model_file)


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded string"


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Encode every text, decode the ids, and return digests of both.

    Returns id_col, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256; with decoded=True also the decoded text itself. A null text
    counts as empty; an empty text has no ids. Very long texts are encoded whole,
    in time that grows with their length, also where no space cuts them. Equal texts get
    equal results and repeated rows are encoded each. An empty table gives no rows; other
    columns, whatever their names, are ignored. model_file is a file that every executor
    has at that path.
    """
    kind = docs.schema[id_col].dataType
    schema = f"_id string, {SCHEMA if decoded else SCHEMA.rsplit(',', 1)[0]}"

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(c, pa.int64() if c == "n_tokens" else pa.string()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        gc.disable()  # what is remembered has no cycles, and looking through it takes time
        try:
            for batch in batches:
                # One block of texts at a time are Python objects.
                columns: list[list] = [[] for _ in names[1:]]
                for ids in enc.encode_all(t.as_py() or "" for t in batch.column(1)):
                    back = enc.lib.decode(ids) if ids else ""
                    for column, value in zip(columns, (len(ids), sha(",".join([enc.text[i] for i in ids])), sha(back), back)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k.type) for c, k in zip(columns, list(kinds)[1:]))], schema=kinds)
        finally:
            gc.enable()
        give_back()

    # Ids as text, whatever their type.
    out = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.select(F.col("_id").cast(kind).alias(id_col), *[c for c in out.columns if c != "_id"])


def encode_ids(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with an array column of the ids of each text (null text: empty array)."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(model_file)
        for batch in texts:
            yield pd.Series(list(enc.encode_all(t or "" for t in batch)), dtype=object)

    return docs.withColumn(out_col, ids(F.col(text_col)))
