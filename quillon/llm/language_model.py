"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node (context, bits so far). For
every context of 0 to DEPTH bytes a Krichevsky-Trofimov estimate predicts the
bit. Context-tree weighting mixes the estimates of all depths: a node's block
probability is half its own estimate and half the product of its children's, and
the same shares weigh the predictions on the way down. Where a context hasn't
been seen, the deepest one that has takes the rest of the weight.

After training, a byte's probability depends on DEPTH bytes before it only, so a
text's score is a sum over its (DEPTH + 1)-byte strings. Strings are gathered in
three steps, none of which broadcasts or collects anything that grows:

1. documents are dealt into blocks; a block gives its distinct strings and
   words with their training counts, as sorted and compressed arrays;
2. arrays are regrouped by the last two context bytes (a whole subtree of the
   context tree) or by the word's hash; there the values are computed for
   all strings and words that occur anywhere, and sent back to their blocks;
3. each block meets its documents again and sums up.

Only the two top levels of the tree, at most 65,536 sums, pass the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, give_back, held_out, materialise, shuffle_partitions
from .packed import loosen, loosen_sorted, squeeze, squeeze_sorted

#: Bytes of context.
DEPTH = 5
#: UTF-8 bytes of text in a block, about.
BLOCK = 24 << 20
#: Bytes that are looked up at once.
CHUNK = 1 << 21
#: The end of a text as a token and as a byte; no word has this key's bytes.
END = xxhash.xxh64_intdigest(b"\n")
_LN10, _LN2 = math.log(10), math.log(2)
_MASK = [(1 << 8 * d) - 1 for d in range(9)]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (depth + 1)-byte strings of texts with their ends, and where each text's begin."""
    lead = b"\0" * depth
    data = np.frombuffer(b"".join([lead + t + b"\0" for t in texts]), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    # Position of each predicted byte in data.
    at = np.arange(start[-1]) + np.repeat(np.arange(1, len(texts) + 1) * depth, size)
    code = np.zeros(len(at), np.uint64)
    for back in range(depth, -1, -1):
        code = (code << np.uint64(8)) | data[at - back]
    return code, start[:-1]


# --- the tree -----------------------------------------------------------------

_SMALL = 1 << 16
_LGAMMA_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))))  # ln Γ(n + ½) - ln Γ(½)
_LGAMMA_ONE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _SMALL)))))  # ln n!


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _lookup(table: np.ndarray, n: np.ndarray, shift: float, base: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    if large.any():
        out[large] = _stirling(n[large] + shift) - base
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the block estimate for a zeros and b ones."""
    half = 0.5 * math.log(math.pi)
    return _lookup(_LGAMMA_HALF, a, 0.5, half) + _lookup(_LGAMMA_HALF, b, 0.5, half) - _lookup(_LGAMMA_ONE, a + b, 1.0, 0.0)


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes of (context, byte) keys: their keys, counts of zeros and of ones."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    node, ones = [], []
    for k in range(8):
        node.append((keys & ~np.uint64(255)) | ((1 << k) | (byte >> (8 - k))).astype(np.uint64))
        ones.append(np.where((byte >> (7 - k)) & 1, counts, 0))
    every = np.tile(counts, 8)
    node, ones = np.concatenate(node), np.concatenate(ones)
    order = np.argsort(node, kind="stable")
    node = node[order]
    if not len(node):
        return node, every, ones
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    total, b = np.add.reduceat(every[order], first), np.add.reduceat(ones[order], first)
    return node[first], total - b, b


def _mix(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted block probability, and the own estimate's share of it."""
    both = np.logaddexp(own, below) - _LN2
    return both, np.exp(own - _LN2 - both)


class Tree:
    """Subtrees of depth 2 and more over some strings with training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        seen = counts > 0
        self.keys, self.counts = keys[seen], counts[seen]
        self.level: dict[int, dict[str, np.ndarray]] = {}
        k, c = self.keys, self.counts
        for d in range(depth, 1, -1):
            if d < depth:
                k, c = summed(k & np.uint64(_MASK[d + 1]), c)
            node, a, b = _nodes(k, c)
            own = log_kt(a, b)
            if d == depth:
                block, share = own, np.ones(len(own))
            else:
                deeper = self.level[d + 1]
                parent = np.searchsorted(node, deeper["node"] & np.uint64(_MASK[d + 1]))
                block, share = _mix(own, np.bincount(parent, deeper["block"], len(node)))
            self.level[d] = {"node": node, "ones": (b + 0.5) / (a + b + 1), "block": block, "share": share}

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the subtrees: counts by (context byte, byte), log blocks by (context byte, node)."""
        pair = (self.keys & np.uint64(0xFFFF)).astype(np.int64)
        nodes = self.level[2]
        at = (nodes["node"] & np.uint64(0xFFFF)).astype(np.int64)
        return np.bincount(pair, self.counts, 65536), np.bincount(at, nodes["block"], 65536)

    def log10(self, keys: np.ndarray, top: Top) -> np.ndarray:
        """Log10 probability of each string's last byte after the others."""
        for d in range(2, self.depth + 1):
            x = self.level[d]
            if d == 2:
                at = (x["node"] & np.uint64(0xFFFF)).astype(np.int64)
                done, rest = top.done[at], top.rest[at]
            else:
                up = self.level[d - 1]
                at = np.searchsorted(up["node"], x["node"] & np.uint64(_MASK[d]))
                done, rest = up["done"][at], up["rest"][at]
            x["final"] = done + rest * x["ones"]
            x["done"], x["rest"] = done + rest * x["share"] * x["ones"], rest * (1 - x["share"])
        out = np.zeros(len(keys))
        byte = (keys & np.uint64(255)).astype(np.int64)
        for k in range(8):
            node = (keys & ~np.uint64(255)) | ((1 << k) | (byte >> (8 - k))).astype(np.uint64)
            p = top.final[(node & np.uint64(0xFFFF)).astype(np.int64)].copy()
            left = np.arange(len(keys))
            for d in range(self.depth, 1, -1):
                x = self.level[d]
                if not len(left) or not len(x["node"]):
                    continue
                want = node[left] & np.uint64(_MASK[d + 1])
                at = np.minimum(np.searchsorted(x["node"], want), len(x["node"]) - 1)
                hit = x["node"][at] == want
                p[left[hit]] = x["final"][at[hit]]
                left = left[~hit]
            out += np.log(np.where((byte >> (7 - k)) & 1, p, 1 - p))
        return out / _LN10


class Top:
    """The tree's levels 0 and 1, from the sums over all subtrees."""

    def __init__(self, counts: np.ndarray, blocks: np.ndarray):
        """counts: by context byte * 256 + byte; blocks: log blocks of level 2 by context byte * 256 + node."""
        counts = np.asarray(counts, np.int64).reshape(256, 256)
        a, b = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)
        byte = np.arange(256)
        for k in range(8):
            node, one = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            np.add.at(b, (slice(None), node[one == 1]), counts[:, one == 1])
            np.add.at(a, (slice(None), node[one == 0]), counts[:, one == 0])
        a0, b0 = a.sum(0), b.sum(0)
        block1, share1 = _mix(log_kt(a, b), np.asarray(blocks).reshape(256, 256))
        _, share0 = _mix(log_kt(a0, b0), block1.sum(0))
        ones0, ones1 = (b0 + 0.5) / (a0 + b0 + 1), (b + 0.5) / (a + b + 1)
        done0, rest0 = share0 * ones0, 1 - share0
        seen = (a + b) > 0
        # What a string gets that no deeper context has seen.
        self.final = np.where(seen, done0 + rest0 * ones1, ones0[None]).reshape(-1)
        self.done = (done0 + rest0 * share1 * ones1).reshape(-1)
        self.rest = (rest0 * (1 - share1)).reshape(-1)


# --- a block ------------------------------------------------------------------


class Index:
    """Values by 64-bit key, in an open-addressed table that whole arrays are looked up in."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = keys, values
        self.slot = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            placed = self.slot[at] == left
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, all of which must be there."""
        at = self._home(keys)
        found = self.slot[at]
        wrong = np.flatnonzero(self.keys[found] != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            got = self.slot[at[wrong]]
            if (got < 0).any():
                raise KeyError("a string that its block didn't report")
            found[wrong] = got
            wrong = wrong[self.keys[got] != keys[wrong]]
        return self.values[found]


def _word_keys() -> Remembered:
    return Remembered(xxhash.xxh64_intdigest, 100_000)


def _of_part(keys: np.ndarray, kind: str, parts: int) -> np.ndarray:
    """Which part computes a key's value."""
    if kind == "word":
        return (keys % np.uint64(parts)).astype(np.int64)
    subtree = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((subtree * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _gather(parts: int, depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_key, found = _word_keys(), {}

        def add(block: int, kind: str, keys: np.ndarray, train: bool) -> None:
            keys = np.sort(keys)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(first, len(keys))) if train else np.zeros(len(first), np.int64)
            have = found.setdefault((block, kind), [])
            have.append((keys[first], n))
            if len(have) > 8:
                found[block, kind] = [summed(*map(np.concatenate, zip(*have)))]

        for batch in batches:
            for (block, out), rows in batch.groupby(["_block", "_out"]):
                texts, size = [], 0
                last = len(rows) - 1
                for k, text in enumerate(rows["_text"]):
                    texts.append((text or "").encode().lower())
                    size += len(texts[-1]) + 1
                    if k == last or size > CHUNK:
                        add(block, "string", strings(texts, depth)[0], not out)
                        words = [w for t in texts for w in t.split()]
                        keys = np.fromiter(map(word_key.__getitem__, words), np.uint64, len(words))
                        add(block, "word", np.append(keys, np.full(len(texts), END, np.uint64)), not out)
                        texts, size = [], 0
        for (block, kind), have in found.items():
            keys, n = summed(*map(np.concatenate, zip(*have)))
            of = _of_part(keys, kind, parts)
            order = np.argsort(of, kind="stable")
            edge = np.searchsorted(of[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = order[edge[p] : edge[p + 1]]
                if len(own):
                    rows.append((kind, p, block, squeeze_sorted(keys[own]), squeeze(n[own].astype("<i8"))))
            yield pd.DataFrame(rows, columns=["kind", "part", "block", "keys", "counts"])
        found.clear()
        give_back()

    return run


def _total(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each row, all distinct keys, and their training counts."""
    each = [loosen_sorted(k) for k in rows["keys"]]
    return each, *summed(np.concatenate(each), np.concatenate([loosen(c, "<i8") for c in rows["counts"]]))


def log_scores(docs: DataFrame, folds: int = 7, fold: int = 2, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents under models of those outside the held-out fold.

    Returns id_col, held_out, n_tokens (words of the lower-cased text and one
    end), n_known (those seen in training), train_tokens, base_score (log10, word
    counts plus one), score (log10 probability of the lower-cased text and its
    end by context-tree weighting), n_bytes and bits_per_byte. A null text counts
    as empty: one end token. A null id belongs to no held-out fold. Repeated rows
    count and are scored each. Without training rows all counts are 0 and each
    bit has probability one half. Whole texts count, however long, CHUNK bytes of them
    at a time. A NUL character in a text is the symbol that also stands for the end and for what
    is before a text. Equal texts get equal scores. Other columns, whatever their names, are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), held_out(F.col(id_col), folds, fold).alias("_out"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", F.length("_text"), F.substring("_text", 1, 64)), F.lit(blocks)).cast("int"))
    parts = blocks
    found = materialise(
        rows.repartition(blocks, "_block").mapInPandas(_gather(parts, depth), "kind string, part int, block int, keys binary, counts binary"), "lm-found"
    )

    def words(rows: pd.DataFrame) -> pd.DataFrame:
        each, keys, n = _total(rows)
        out = rows[["kind", "block"]].copy()
        out["keys"] = rows["keys"]
        out["values"] = [squeeze(n[np.searchsorted(keys, k)].astype("<f8")) for k in each]
        out["distinct"], out["total"] = 0, 0
        out.iloc[0, out.columns.get_loc("distinct")] = int((n > 0).sum())
        out.iloc[0, out.columns.get_loc("total")] = int(n.sum())
        return out

    valued = "kind string, block int, keys binary, values binary"
    counted = materialise(found.where("kind = 'word'").groupBy("part").applyInPandas(words, valued + ", distinct long, total long"), "lm-words")
    distinct, total = (int(x or 0) for x in counted.agg(F.sum("distinct"), F.sum("total")).first())

    def tops(rows: pd.DataFrame) -> pd.DataFrame:
        _, keys, n = _total(rows)
        counts, log_blocks = Tree(keys, n, depth).top()
        at = np.flatnonzero((counts > 0) | (log_blocks != 0))
        return pd.DataFrame({"at": at, "n": counts[at].astype(np.int64), "block": log_blocks[at]})

    subtrees = found.where("kind = 'string'").groupBy("part")
    counts, log_blocks = np.zeros(65536), np.zeros(65536)
    # At most 65,536 rows, whatever the input.
    for at, n, block in subtrees.applyInPandas(tops, "at int, n long, block double").groupBy("at").agg(F.sum("n"), F.sum("block")).collect():
        counts[at], log_blocks[at] = n, block
    top = Top(counts, log_blocks)

    def values(rows: pd.DataFrame) -> pd.DataFrame:
        each, keys, n = _total(rows)
        log10 = Tree(keys, n, depth).log10(keys, top)
        out = rows[["kind", "block"]].copy()
        out["keys"] = rows["keys"]
        out["values"] = [squeeze(log10[np.searchsorted(keys, k)].astype("<f8")) for k in each]
        return out

    table = counted.select("kind", "block", "keys", "values").unionByName(subtrees.applyInPandas(values, valued))
    least = math.log10(1 / (total + distinct + 1))

    def scores(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        give_back()
        index = {}
        for kind, rows in table.groupby("kind"):
            keys, vals = np.concatenate([loosen_sorted(k) for k in rows["keys"]]), np.concatenate([loosen(v, "<f8") for v in rows["values"]])
            index[kind] = Index(keys, vals)
        word_key, parts, texts, size = _word_keys(), [], [], 0
        last = len(docs) - 1
        for k, text in enumerate(docs["_text"]):
            texts.append((text or "").encode().lower())
            size += len(texts[-1]) + 1
            if k < last and size <= CHUNK:
                continue
            code, start = strings(texts, depth)
            score = np.add.reduceat(index["string"][code], start)
            lists = [t.split() for t in texts]
            n = np.array([len(w) + 1 for w in lists])
            first = np.concatenate(([0], np.cumsum(n)))
            keys = np.full(first[-1], END, np.uint64)
            inner = np.ones(first[-1], bool)
            inner[first[1:] - 1] = False
            keys[inner] = np.fromiter((word_key[w] for ws in lists for w in ws), np.uint64, int(first[-1]) - len(texts))
            c = index["word"][keys]
            base = np.add.reduceat(np.log10(c + 1), first[:-1]) + n * least
            known = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
            parts.append(pd.DataFrame({"n_tokens": n, "n_known": known, "base_score": base, "score": score, "n_bytes": [len(t) for t in texts]}))
            texts, size = [], 0
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["n_tokens", "n_known", "base_score", "score", "n_bytes"])
        out.insert(0, "_id", docs["_id"].to_numpy())
        out.insert(1, "held_out", docs["_out"].to_numpy())
        out["train_tokens"] = total
        out["bits_per_byte"] = -out["score"] * _LN10 / _LN2 / (out["n_bytes"] + 1)
        return out[["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]]

    # Ids as text, so that pandas doesn't turn those with nulls among them into doubles.
    kind = docs.schema[id_col].dataType
    schema = "_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return rows.withColumnRenamed("_block", "block").groupBy("block").cogroup(table.groupBy("block")).applyInPandas(scores, schema).withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col)
