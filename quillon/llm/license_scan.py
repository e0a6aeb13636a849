"""License scans by diagonal voting.

All rolling word n-grams of all texts are joined on their hashes to the places
that the same n-grams have in the templates. A hit at word i of a text and word j
of a template votes for the diagonal i - j. Phrases must have all their n-grams
on one diagonal. In longer texts words may be missing, added or changed, which
moves what follows to a diagonal nearby; so the hits of diagonals at most BAND
apart are merged, and a span is verified by the share of the template's words
that its n-grams cover, compared as words and not as hashes.

One scan of the texts gives the hits and a row for each text; everything after
it has a row for each hit at most.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .license_texts import PHRASES, TEXTS

#: A word, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Templates of fewer words are phrases, found by n-grams of SHORT words; the others are texts, found by LONG.
PHRASE, SHORT, LONG = 16, 2, 4
#: Diagonals that are merged, to either side.
BAND = 8
#: Per cent of a text's words that a span must have.
LEAST = 80
#: Words of a template at most: the bits of four numbers.
MOST = 252
COVERS = ("c0", "c1", "c2", "c3")


def split_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@cache
def templates() -> list[tuple[str, str, bool, list[str]]]:
    """(label, family, whether it is a base phrase, words)."""
    rows = [(label, family, base, split_words(text)) for some, base in ((PHRASES, True), (TEXTS, False)) for label, family, text in some]
    assert all(SHORT <= len(r[3]) <= MOST for r in rows)
    return rows


def size(words: list[str]) -> int:
    return SHORT if len(words) < PHRASE else LONG


def _places(spark: SparkSession) -> DataFrame:
    """(gram, id, shift, words, said, c0..c3) for each place of each template; c0..c3 have a bit for each word that the n-gram covers."""
    rows = []
    for k, (_, _, _, words) in enumerate(templates()):
        n = size(words)
        for j in range(len(words) - n + 1):
            bits = ((1 << n) - 1) << j
            rows.append((k, j, len(words), words[j : j + n], *((bits >> 63 * i) & ((1 << 63) - 1) for i in range(4))))
    table = spark.createDataFrame(rows, "id int, shift int, words int, parts array<string>, c0 long, c1 long, c2 long, c3 long")
    gram = _hash([F.get("parts", F.lit(i)) for i in range(LONG)])
    return table.select(gram.alias("gram"), "id", "shift", "words", F.concat_ws(" ", "parts").alias("said"), F.size("parts").alias("n"), *COVERS)


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, doc_id, n_words, id, diagonal, words, c0..c3) of all hits, and one with a null id of each row of docs."""
    small = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    words = F.regexp_extract_all(small, F.lit(f"({WORD})"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("all"))
    # One element more, so that each text has a row of its own.
    each = rows.select("row", "doc_id", F.size("all").alias("n_words"), "all", F.posexplode(F.concat("all", F.array(F.lit(None).cast("string")))))
    at = [F.get("all", F.col("pos") + i) for i in range(LONG)]
    short = F.when(F.col("pos") + SHORT <= F.col("n_words"), _hash([*at[:SHORT], *[F.lit(None).cast("string")] * (LONG - SHORT)]))
    long = F.when(F.col("pos") + LONG <= F.col("n_words"), _hash(at)).when(F.col("pos") == F.col("n_words"), F.lit(-1))
    grams = each.select("row", "doc_id", "n_words", "all", "pos", F.explode(F.array(short, long)).alias("gram"))
    # Some thousand places: as many as the templates of this library have words.
    found = grams.join(F.broadcast(_places(docs.sparkSession)), "gram", "left")
    same = F.col("id").isNotNull() & (F.concat_ws(" ", F.slice("all", F.col("pos") + 1, F.col("n"))) == F.col("said"))
    own = (F.col("pos") == F.col("n_words")) & F.col("gram").isNotNull()
    diagonal = (F.col("pos") - F.col("shift")).cast("long").alias("diagonal")
    return found.where(same | own).select("row", "doc_id", "n_words", "id", diagonal, "words", *COVERS)


def _choose(values: list, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number + 1)


def spans(found: DataFrame) -> DataFrame:
    """Verified spans (row, id, label, base, start, share): of phrases each place, of texts each diagonal on which the share is largest within the band."""
    every = templates()
    by = found.where("id IS NOT NULL").groupBy("row", "id", "words", "diagonal")
    votes = by.agg(F.count(F.lit(1)).alias("votes"), *[F.bit_or(c).alias(c) for c in COVERS])
    whole = (F.col("words") < PHRASE) & (F.col("votes") == F.col("words") - SHORT + 1)
    phrases = votes.where(whole).select("row", "id", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    near = Window.partitionBy("row", "id").orderBy("diagonal").rangeBetween(-BAND, BAND)
    covered = reduce(Column.__add__, [F.bit_count(F.bit_or(c).over(near)) for c in COVERS])
    texts = votes.where(F.col("words") >= PHRASE).select("row", "id", "diagonal", "votes", "words", covered.alias("covered"))
    texts = texts.where(F.col("covered") * 100 >= F.col("words") * LEAST)
    before = Window.partitionBy("row", "id").orderBy("diagonal")
    # Diagonals that follow each other within the band are one span.
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(before) > BAND).cast("int"), F.lit(1))
    texts = texts.withColumn("begins", begins).withColumn("run", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.max_by("diagonal", F.struct("covered", "votes", -F.col("diagonal"))).alias("start")
    best = texts.groupBy("row", "id", "run", "words").agg(F.max("covered").alias("covered"), first)
    texts = best.select("row", "id", F.greatest("start", F.lit(0)).alias("start"), (F.col("covered") / F.col("words")).alias("share"))
    merged = phrases.unionByName(texts)
    merged = merged.withColumns({name: _choose([t[k] for t in every], F.col("id")) for k, name in enumerate(("label", "family", "base"))})
    of_family = Window.partitionBy("row", "family")
    return merged.withColumn("most", F.max("share").over(of_family)).where("share = most").drop("most", "family")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the licenses that its text names or has.

    Returns id_col, n_words, n_base (places of base phrases), first_word and
    last_word (least and greatest start of these, null without any), base_labels,
    labels and score. Labels are distinct, sorted and joined by commas; none give an
    empty string. A label that isn't a base one comes from a phrase that stands
    somewhere in all its words, or from a text of which LEAST per cent of the words
    or more are covered by n-grams of LONG words on diagonals at most BAND apart; of
    templates of one family only those with the largest share count. The score is
    the largest share of a template that was found, 1 for a phrase, else 0.

    A null text counts as empty; an empty one has no words. Very long texts are
    read whole. Repeated rows, and rows that share an id or have none, are scanned
    each by itself; places that tie all count. An empty table gives no rows. Other columns of docs
    are ignored, whatever their names.
    """
    found = materialise(hits(docs, id_col, text_col), "license-hits")
    own = found.where("id IS NULL").select("row", "doc_id", "n_words")
    got = spans(found).select("row", "label", "base", "start", "share")
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    return (
        own.unionByName(got, allowMissingColumns=True)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias(id_col),
            F.max("n_words").cast("long").alias("n_words"),
            F.count(base).alias("n_base"),
            F.min(base).alias("first_word"),
            F.max(base).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def _values() -> str:
    rows = ((k, label, family, base, " ".join(words), size(words)) for k, (label, family, base, words) in enumerate(templates()))
    return ", ".join("({}, '{}', '{}', {}, '{}', {})".format(*r) for r in rows)


ORACLE = rf"""
WITH t AS (SELECT *, string_split(said, ' ') AS w FROM (VALUES {_values()}) v(id, label, family, base, said, n)),
g AS (SELECT id, n, len(w) AS size, j, array_to_string(w[j + 1 : j + n], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - n + 1)) AS j FROM t)),
d AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
e AS (SELECT nr, w, unnest(range(len(w))) AS i FROM d),
h AS (SELECT nr, id, size, i - j AS diagonal, j FROM (SELECT nr, i, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM e, (VALUES ({SHORT}), ({LONG})) v(n) WHERE i + n <= len(w)) JOIN g USING (gram, n)),
p AS (SELECT nr, id, diagonal, 1.0::DOUBLE AS share FROM h WHERE size < {PHRASE} GROUP BY nr, id, diagonal, size HAVING count(*) = size - {SHORT} + 1),
v AS (SELECT nr, id, size, diagonal, count(*) AS votes FROM h WHERE size >= {PHRASE} GROUP BY ALL),
c AS (SELECT v.nr, v.id, v.size, v.diagonal, v.votes, count(DISTINCT h.j + o) AS covered FROM v JOIN h ON h.nr = v.nr AND h.id = v.id AND h.diagonal BETWEEN v.diagonal - {BAND} AND v.diagonal + {BAND}, range({LONG}) r(o) GROUP BY ALL HAVING covered * 100 >= v.size * {LEAST}),
b AS (SELECT *, diagonal - coalesce(lag(diagonal) OVER (PARTITION BY nr, id ORDER BY diagonal), diagonal - {BAND} - 1) > {BAND} AS begins FROM c),
s AS (SELECT *, sum(begins::INT) OVER (PARTITION BY nr, id ORDER BY diagonal) AS run FROM b),
x AS (SELECT nr, id, greatest(first(diagonal ORDER BY covered DESC, votes DESC, diagonal), 0) AS start, max(covered) / size AS share FROM s GROUP BY nr, id, run, size UNION ALL SELECT nr, id, diagonal, share FROM p),
f AS (SELECT x.*, label, base, max(share) OVER (PARTITION BY nr, family) AS most FROM x JOIN t USING (id))
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0) AS score
FROM d LEFT JOIN f ON f.nr = d.nr AND f.share = f.most GROUP BY d.nr, d.doc_id, d.w
"""
