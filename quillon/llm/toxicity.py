"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams and
of the word itself; a passage's vector is the mean of its words', and a linear
softmax tells toxic from clean. Vectors and softmax are trained jointly in
numpy. A misspelling or an unseen ending shares n-grams with words seen, so it
shares their vectors.

A few insults in a long text would drown in one mean, so a text is scored as its
worst passage of PASSAGE consecutive words (all words count, wherever and however
often they stand), and training takes each text's worst passage under the
present model.

Between n-grams and logit all is linear, so a trained model is one number for
each hash bucket.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, lowest
from .textgrams import Words, pieces, words

#: Labelled rows of each class that training takes at most, by hash of the id.
SAMPLE = 3000
PASSAGE = 2
#: Rejecting a share of the clean texts costs so much more than missing that share of the toxic ones.
CLEAN_COST = 2.0
#: Parts of the sample: the bias is set by models of which each is trained without one part.
PARTS = 3
BUCKETS = 1 << 17
DIMS = 8
SHORTEST, LONGEST = 4, 6


def _worst(scores: np.ndarray) -> tuple[int, float]:
    """Start and mean of the highest-scoring passage of one text."""
    if len(scores) <= PASSAGE:
        return 0, float(scores.mean()) if len(scores) else 0.0
    means = _means(scores)
    at = int(means.argmax())
    return at, float(means[at])


def _means(scores: np.ndarray) -> np.ndarray:
    """Mean of the PASSAGE scores from each place on."""
    n = len(scores) - PASSAGE + 1
    return sum(scores[k : k + n] for k in range(PASSAGE)) / PASSAGE


def word_scores(w: Words, weight: np.ndarray) -> np.ndarray:
    """Mean weight of each word's n-grams and of the word; weight has a last zero for what is no n-gram."""
    total = np.zeros(int(w.start[-1] + w.length[-1] + 1))
    n = np.ones(len(w.start))
    for k in range(SHORTEST, LONGEST + 1):
        total += weight[w.hashes(k, BUCKETS)]
        n += np.maximum(w.length + 3 - k, 0)
    return (np.add.reduceat(total, w.start) + weight[w.whole(BUCKETS)]) / n


def logits(texts: Sequence[str | None], model: tuple[np.ndarray, float]) -> np.ndarray:
    """Logit of each text's worst passage; of no words, the bias."""
    weight, bias = np.append(model[0], 0.0), model[1]
    total, count, top = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf)
    last, of = np.empty(0), np.empty(0, np.int64)
    for block in pieces(texts):
        w = words(block)
        if not len(w.start):
            continue
        s = word_scores(w, weight)
        total += np.bincount(w.text, s, len(texts))
        count += np.bincount(w.text, minlength=len(texts))
        # A passage may go on from one block into the next.
        s, of = np.concatenate((last, s)), np.concatenate((of, w.text))
        if len(s) >= PASSAGE:
            begin = of[: len(of) - PASSAGE + 1]
            whole = begin == of[PASSAGE - 1 :]
            np.maximum.at(top, begin[whole], _means(s)[whole])
        last, of = s[len(s) - PASSAGE + 1 :], of[len(of) - PASSAGE + 1 :]
    return bias + np.where(count >= PASSAGE, top, total / np.maximum(count, 1))


def threshold(logits: np.ndarray, toxic: np.ndarray, clean_cost: float = CLEAN_COST) -> float:
    """Where to part toxic from clean: the middle of the cheapest span of logits."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], toxic[order]
    # Cost of rejecting all from position k on, by share of each class.
    missed = np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())
    wrong = np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0])) / max(1, (1 - y).sum())
    cost = missed + clean_cost * wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[len(best) // 2]
    low = x[k - 1] if k else x[0] - 1
    high = x[k] if k < len(x) else x[-1] + 1
    return float((low + high) / 2)


class Bags:
    """Texts as numbers of distinct words, and each distinct word's buckets."""

    def __init__(self, texts: Sequence[str]):
        numbers: dict[int, int] = {}
        flat, size, docs = array("i"), array("i"), [[] for _ in texts]
        for block in pieces(texts):
            w = words(block)
            if not len(w.start):
                continue
            keys = w.keys().tolist()
            fresh = [k for k, key in enumerate(keys) if key not in numbers and not numbers.update({key: len(numbers)})]
            grams = [w.hashes(n, BUCKETS) for n in range(SHORTEST, LONGEST + 1)]
            whole = w.whole(BUCKETS)
            for k in fresh:
                own = slice(w.start[k], w.start[k] + w.length[k] + 1)
                ids = np.concatenate([g[own] for g in grams])
                ids = np.append(ids[ids < BUCKETS], whole[k])
                flat.frombytes(ids.astype(np.int32).tobytes())
                size.append(len(ids))
            ids = np.array([numbers[k] for k in keys], np.int32)
            cuts = np.flatnonzero(np.diff(w.text)) + 1
            for part, of in zip(np.split(ids, cuts), w.text[np.concatenate(([0], cuts))]):
                docs[of].append(part)
        self.docs = [np.concatenate(d) if d else np.empty(0, np.int32) for d in docs]
        self.flat, self.size = np.array(flat, np.int32), np.array(size, np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), self.size)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """Mean weight of each distinct word."""
        return np.bincount(self.owner, weight[self.flat], len(self.size)) / self.size


def train(texts: list[str], toxic: list[int], **options) -> tuple[np.ndarray, float]:
    """Logit of each bucket, and the bias.

    The vectors are trained on all texts. The bias is set where the texts are parted
    best, each scored by a model that was trained without its part of the sample.
    Without both classes, all is constant.
    """
    y = np.asarray(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(BUCKETS), math.log(share / (1 - share))
    bags, part, found = Bags(texts), np.empty(len(y), np.int64), np.empty(len(y))
    weight, bias = _train(bags, np.arange(len(y)), y, **options)
    if min(y.sum(), len(y) - y.sum()) < PARTS:
        return weight, bias
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % PARTS
    for p in range(PARTS):
        other, at = _train(bags, np.flatnonzero(part != p), y, **options)
        word = bags.scores(other)
        for k in np.flatnonzero(part == p):
            found[k] = at + _worst(word[bags.docs[k]])[1]
    return weight, bias - threshold(found, y)


def _train(bags: Bags, rows: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, seed: int = 3) -> tuple[np.ndarray, float]:
    """At least 8 turns over the rows, and as many as give `steps` steps of 32 rows."""
    rounds = max(8, -(-32 * steps // max(1, len(rows))))
    docs, y = [bags.docs[k] for k in rows], y[rows]
    flat, size, start = bags.flat, bags.size, bags.start
    rng = np.random.default_rng(seed)
    vectors = (rng.uniform(-1, 1, (BUCKETS, DIMS)) / DIMS).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIMS, 2))
    bias = np.zeros(2)
    past_v, past_s, past_b = np.full((BUCKETS, DIMS), 1e-8, np.float32), np.full((DIMS, 2), 1e-8), np.full(2, 1e-8)
    classes = np.where(y[:, None] == [0, 1], 1.0, 0.0)
    for turn in range(rounds):
        word = bags.scores(vectors @ (soft[:, 1] - soft[:, 0]))
        # At first any passage may hold the insult, so the first turns take the whole text.
        parts = [d if turn < 2 else d[(at := _worst(word[d])[0]) : at + PASSAGE] for d in docs]
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 32)):
            ids = np.concatenate([parts[i] for i in some])
            if not len(ids):
                continue
            of = np.repeat(np.arange(len(some)), [len(parts[i]) for i in some])
            length = np.maximum(np.bincount(of, minlength=len(some)), 1)
            n = size[ids]
            at = np.repeat(start[ids] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            part = 1.0 / np.repeat(n * length[of], n)
            # Sparse text-by-bucket matrix, summed by (text, bucket).
            key, back = np.unique(np.repeat(of, n).astype(np.int64) * BUCKETS + flat[at], return_inverse=True)
            value = np.bincount(back, part)
            row, col = key // BUCKETS, key % BUCKETS
            mean = np.stack([np.bincount(row, value * vectors[col, d], len(some)) for d in range(DIMS)], 1)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - classes[some]) / len(some)
            to_mean = error @ soft.T
            used, slot = np.unique(col, return_inverse=True)
            step = np.stack([np.bincount(slot, value * to_mean[row, d], len(used)) for d in range(DIMS)], 1)
            past_v[used] += step**2
            vectors[used] -= rate * step / np.sqrt(past_v[used])
            g = mean.T @ error
            past_s += g**2
            soft -= rate * g / np.sqrt(past_s)
            past_b += error.sum(0) ** 2
            bias -= rate * error.sum(0) / np.sqrt(past_b)
    return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(_id, _text, _toxic) of at most `sample` rows of each class outside the held-out fold.

    The ids are those that hash lowest among the labels (see `lowest`); where they have more
    rows than `sample`, texts count in order. Null ids, labels and texts take no part, nor
    do ids whose labels disagree; a label said twice counts once.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where("_id IS NOT NULL").where(F.col("_toxic").isin(0, 1)).where(~held_out(F.col("_id"), folds, fold))
    known = known.groupBy("_id").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_most")).where("_toxic = _most").select("_id", "_toxic", F.xxhash64("_id").alias("_nr"))
    picked = lowest(known, "_toxic", ["_nr", "_id"], sample)  # at most 2 * sample narrow rows, so a broadcast is safe
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(picked), "_id")
    return lowest(rows, "_toxic", ["_nr", "_id", "_text"], sample).select("_id", "_text", "_toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Train on the rows of `sampled`: at most `sample` of each class reach the driver."""
    rows = sorted(sampled(docs, labels, sample, folds, fold, id_col, text_col, label_col).collect(), key=lambda r: (r["_id"], r["_text"]))
    model = train([r["_text"] for r in rows], [r["_toxic"] for r in rows])
    rows.clear()
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """Score of every text in 0 to 1, and predicted (1 from 0.5 on).

    Returns id_col, score, predicted; with keep all columns of docs and those two,
    their names beginning with keep (docs may have columns `score` and `predicted`
    then; without keep other columns are ignored). A null or empty text, or one
    without a letter or digit, gets the score of the bias alone. Whole texts count,
    however long, in blocks of words. Equal texts get equal scores and repeated rows
    are scored each; an empty table gives no rows.
    """
    weight, bias = model
    context = docs.sparkSession.sparkContext.broadcast(weight)  # BUCKETS floats

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits(batch.tolist(), (context.value, bias)), -60, 60))), dtype="float64")
        give_back()

    if keep:
        return docs.withColumn(f"{keep}score", scored(F.col(text_col))).withColumn(f"{keep}predicted", (F.col(f"{keep}score") >= 0.5).cast("int"))
    return docs.select(F.col(id_col), scored(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
