"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit one binary classifier, linear
in the shares of a whole text's hashed character n-grams, tells the languages
with a 1 from those with a 0; the bits' classifiers are trained together in
numpy. A text's margins are decoded by loss: each codeword costs the sum of
logistic losses over its bits, weighted by how well the bit's classifier did in
training, and the cheapest codeword wins; of equally cheap ones, the language
that comes first by name. A text whose two cheapest codewords cost nearly the
same is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, lowest
from .textgrams import pieces, words

#: Labelled rows of each language that training takes at most, by hash of the id.
SAMPLE = 500
BUCKETS = 1 << 12
LONGEST = 3
#: A text is ambiguous if its best language has less than this share.
CLEAR = 0.6


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords as rows of 0 and 1: the exhaustive code up to 6, else random columns."""
    if n <= 1:
        return np.zeros((n, 1), dtype=int)
    if n <= 6:
        columns = [(1, *c) for c in itertools.product((0, 1), repeat=n - 1) if not all(c)]
        return np.array(columns).T
    rng, columns = np.random.default_rng(seed), set()
    while len(columns) < int(np.ceil(10 * np.log2(n))):
        c = rng.integers(0, 2, n)
        if c.min() != c.max():
            columns.add(tuple(c if c[0] else 1 - c))
    return np.array(sorted(columns)).T


def shares(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of text, its share of each bucket) of texts with a letter or digit, whole, in order."""
    counts, now = np.zeros(BUCKETS + 1, np.int64), -1
    for block in pieces(texts):
        w = words(block)
        if not len(w.start):
            continue
        grams = [w.hashes(n, BUCKETS) for n in range(1, LONGEST + 1)]
        first = np.flatnonzero(np.diff(w.text, prepend=-1))
        for of, begin, end in zip(w.text[first].tolist(), w.start[first].tolist(), [*w.start[first[1:]].tolist(), len(grams[0])]):
            if of != now:
                if now >= 0:
                    yield now, counts[:BUCKETS] / counts[:BUCKETS].sum()
                counts, now = np.zeros(BUCKETS + 1, np.int64), of
            for g in grams:
                counts += np.bincount(g[begin:end], minlength=BUCKETS + 1)
    if now >= 0:
        yield now, counts[:BUCKETS] / counts[:BUCKETS].sum()


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, summing to 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and share of the nearest codeword, for rows of margins."""
        sign = 2 * self.code - 1
        loss = np.logaddexp(0, -margins[:, None, :] * sign[None]) @ self.trust
        z = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        z /= z.sum(1, keepdims=True)
        best = z.argmax(1)
        return best, z[np.arange(len(z)), best]


def train(x: np.ndarray, languages: Sequence[str], rounds: int = 200) -> Model:
    """A model from rows of shares and their languages."""
    names = tuple(sorted(set(languages)))
    code = codewords(len(names))
    bits = code.shape[1]
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, bits)), np.zeros(bits), np.ones(bits) / bits)
    x, of = np.asarray(x, np.float32), np.array([names.index(lang) for lang in languages])
    y = (2 * code[of] - 1).astype(np.float32)
    balance = (1 / np.bincount(of, minlength=len(names)))[of].astype(np.float32)
    balance /= balance.sum()
    scale = np.float32(1 / max(1e-9, np.sqrt((x**2).sum(1).mean())))
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):
        margin = (x @ w) * scale + b
        g = -y * balance[:, None] / (1 + np.exp(np.clip(y * margin, -30, 30)))
        gw, gb = (x.T @ g) * scale + 1e-6 * w, g.sum(0)
        for p, d, a, v in ((w, gw, m1, m2), (b, gb, c1, c2)):
            a += 0.1 * (d - a)
            v += 0.01 * (d * d - v)
            p -= 0.3 * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    good = ((((x @ w) * scale + b) * y > 0) * balance[:, None]).sum(0)
    trust = np.maximum(2 * good - 1, 1e-3)
    return Model(names, code, (w * scale).astype(np.float64), b.astype(np.float64), trust / trust.sum())


def sampled(docs: DataFrame, sample: int = SAMPLE, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _text, _lang) of at most `sample` rows of each language outside the held-out fold.

    The ids are those that hash lowest; where they have more rows than `sample`,
    texts count in order. Null ids, texts and languages take no part.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where("_id IS NOT NULL AND _lang IS NOT NULL AND _text IS NOT NULL").where(~held_out(F.col("_id"), folds, fold)).withColumn("_nr", F.xxhash64("_id"))
    picked = lowest(rows.select("_nr", "_id", "_lang"), "_lang", ["_nr", "_id"], sample).distinct()
    # At most `sample` narrow rows a language, which the model on the driver needs anyway: a broadcast is safe.
    return lowest(rows.join(F.broadcast(picked), ["_nr", "_id", "_lang"]), "_lang", ["_nr", "_id", "_text"], sample).select("_id", "_text", "_lang")


def fit(docs: DataFrame, sample: int = SAMPLE, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the whole texts of `sampled`.

    The driver gets at most `sample` vectors of BUCKETS floats a language, however
    long the texts are; texts without a letter or digit teach nothing. A language with any labelled
    text that can be sampled is learned, however rare.
    """

    @F.pandas_udf("binary")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out: list[bytes | None] = [None] * len(batch)
            for k, x in shares(batch.tolist()):
                out[k] = x.astype(np.float32).tobytes()
            yield pd.Series(out, dtype=object)

    rows = sampled(docs, sample, folds, fold, id_col, text_col, lang_col).select("_lang", vector("_text").alias("x")).where("x IS NOT NULL").collect()
    rows = sorted((r["_lang"], bytes(r["x"])) for r in rows)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), BUCKETS)
    return train(x, [r[0] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """Language of every whole text.

    Returns id_col, lang_pred, score (share of the nearest codeword, 0 to 1) and
    ambiguous; with keep all columns of docs, whatever their names, and a struct
    column named keep with those three. A null text or one without any letter is
    `und` with score 0 and not ambiguous. With nothing learned all is `und`. Very
    long texts are read whole, in blocks of words. Equal texts get equal results and repeated rows a row
    each; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def lid(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = context.value
        for batch in texts:
            batch = batch.tolist()
            names, score = np.full(len(batch), "und", dtype=object), np.zeros(len(batch))
            if model.languages:
                known = [k for k, text in enumerate(batch) if text and any(map(str.isalpha, text))]
                margins = np.zeros((len(known), model.code.shape[1]))
                for k, x in shares([batch[k] for k in known]):
                    margins[k] = x @ model.weights + model.bias
                best, share = model.decode(margins)
                names[known], score[known] = np.array(model.languages, dtype=object)[best], share
            yield pd.DataFrame({"lang_pred": names, "score": score, "ambiguous": (names != "und") & (score < CLEAR)})
        give_back()

    if keep:
        return docs.withColumn(keep, lid(F.col(text_col)))
    return docs.select(F.col(id_col), lid(F.col(text_col)).alias("_lid")).select(id_col, "_lid.*")
