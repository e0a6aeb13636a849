"""A corpus pipeline: each stage reads all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language_id, mixing, ngram_join, sentencepiece_bpe, toxicity
from quillon.llm.common import materialise, table
from quillon.llm.queries import tokenizer_file


#: Begins the names of columns that a stage adds for itself; docs may have any others.
OWN = "_quillon_stage_"
ROW, HASH, GROUP, COPIES = f"{OWN}row", f"{OWN}hash", f"{OWN}group", f"{OWN}copies"


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, written down: rows of one id, or of none, are told apart by it."""
    return materialise(docs.withColumns({ROW: F.monotonically_increasing_id(), HASH: F.xxhash64("text")}), "pipeline-rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects (score of 0.5 or more).

    Each row is judged by its own whole text, however long; equal texts, and so
    repeated rows, get one judgement. A null or empty text has the score that no words have, and
    stays unless most labelled texts are toxic. The id matters only for finding labels; a null id has
    none. Columns of docs keep their names and values. Without rows none come back.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=OWN).where(f"{OWN}predicted = 0").select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which no language can be told: those without a letter.

    Null and empty texts go. The decoder's choice and its `ambiguous` flag reject
    nothing, and where no language could be learned, texts with a letter stay all
    the same. Whole texts are read, however long; repeated rows all stay or all
    go, and a null id, lang or source changes nothing. Columns of docs keep their names
    and values. Without rows none come back.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.predict(docs, model, keep=OWN).where(f"{OWN}.lang_pred != 'und'").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): the one with the least id.

    Of rows with one id, or none, the one whose text hashes lowest stays; of equal
    rows any one. A row without an id stays only where its group has no id.
    Texts without words (null, empty, white) are like nothing and all stay, also repeated
    ones. Whole texts are compared, however long. Columns of docs keep their
    names and values. Without rows none come back.
    """
    rows = _rows(docs)
    groups, _ = ngram_join.join(rows, n=5, similarity=(80, 100), id_col=ROW)
    named = groups.select(ROW, F.col("component_id").alias(GROUP)).join(rows.select(ROW, "doc_id", HASH), ROW)
    first = named.groupBy(GROUP).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", HASH, ROW)).alias(OWN))
    return rows.join(first.select(f"{OWN}.{ROW}"), ROW, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from not at all to three times.

    Every row has its own number of copies, also where several have one id or
    none. Rows without a source form one source. Null, empty and white texts have no
    words, and follow their source's rate; in a source without any words they are not taken. Whole texts are counted, however
    long. Columns of docs keep their names and values. Without rows none come back.
    """
    rows = _rows(docs)
    taken = mixing.mix(rows, key_col=ROW).where("copies > 0").select(ROW, F.col("copies").cast("int").alias(COPIES))
    return rows.join(taken, ROW).withColumn(OWN, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts, a row for each row of docs.

    A null text counts as empty, which has no ids; whole texts are encoded, however
    long. Columns other than doc_id and text are left out. Without rows none come back.
    """
    return sentencepiece_bpe.encode_decode(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained models and tokenizers can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
