"""License scans against plain Python and SQL, with edited texts and odd rows."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import license_scan
from quillon.llm.license_texts import TEXTS

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows):
    out = []
    for doc_id, text in rows:
        words = split(text)
        starts, base, found = [], set(), defaultdict(list)
        for phrase, label in BASE.items():
            p = phrase.split()
            there = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += there
            if there:
                base.add(label)
                found["base", label].append((1.0, label))
        for label, family, said in TEXTS:
            t = split(said)
            if len(t) < 16:
                share = float(any(words[i : i + len(t)] == t for i in range(len(words))))
            else:
                hits = [(i - j, j) for i in range(len(words) - 3) for j in range(len(t) - 3) if words[i : i + 4] == t[j : j + 4]]
                near = [{j + o for e, j in hits if abs(e - d) <= 8 for o in range(4)} for d in {d for d, _ in hits}]
                share = max(map(len, near), default=0) / len(t)
                share = share if share >= 0.8 else 0.0
            if share:
                found[family].append((share, label))
        best = [x for some in found.values() for x in some if x[0] == max(some)[0]]
        labels = ",".join(sorted({label for _, label in best}))
        out.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, max((s for s, _ in best), default=0.0)))
    return sorted(out, key=str)


def edited(text, changes, rng):
    words = text.split()
    for _ in range(changes):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], ["other"], [words[i], "more"], ["a", "b", "c"]])
    return " ".join(words)


def written():
    rng = random.Random(5)
    texts = [t[2] for t in TEXTS]
    rows = [(k, f"before {t} after") for k, t in enumerate(texts)]
    rows += [(100 + k, "intro " * rng.randrange(9) + edited(t, n, rng)) for k, (t, n) in enumerate((t, n) for t in texts if len(split(t)) >= 16 for n in (1, 4, 9, 30))]
    rows += [(300, f"{texts[6]} and again {texts[6]} {texts[9]}"), (301, " ".join(texts)), (302, texts[6][:400]), (303, texts[6][400:])]
    rows += [(400, "MIT License"), (401, "mit-license; MIT  LICENSE\tcc_by CC BY cc by by"), (402, "the mit licenses, gnu general public\nlicense and GNU General License"), (403, "cc " * 50 + "by")]
    rows += [(404, "mit license " * 2000), (405, "émit license mit lîcense 中文mit license"), (406, "the mit license" + "\0mit license"), (407, None), (408, ""), (409, " \t;:"), (None, "apache license"), (None, None)]
    rows += [(410, "w " * 30_000 + "apache license"), (411, "Licensed under CC BY-NC 4.0.")] + [(412, "Apache License, Version 2.0 apache license")] * 3
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(written(), "doc_id long, text string")
    return rows.withColumns({"row": F.lit("clash"), "id": F.lit("clash"), "all": F.lit(None), "words": F.lit(1), "label": F.lit("x")}).repartition(4)


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_as_plain_python(docs):
    got, want = collected(license_scan.scan(docs)), plain(written())
    for a, b in zip(got, want, strict=True):
        assert a == b
    by_id = {r[0]: r for r in got}
    assert by_id[6][6] == "mit" and by_id[6][2] == 0 and by_id[8][6] == "bsd-2-clause" and by_id[9][6] == "bsd-3-clause"
    assert by_id[12][6] == "lgpl" and by_id[11][6] == "gpl" and by_id[14][6] == "cc-by-4.0" and by_id[15][6] == "cc-by-sa-4.0"
    edits = [r for r in got if r[0] is not None and 100 <= r[0] < 300]
    assert any(0.8 <= r[7] < 1 for r in edits) and any(r[7] == 0 for r in edits)


def test_sql_says_the_same(docs):
    some = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("frame", some)
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame WHERE text IS NULL OR doc_id <> 406 OR doc_id IS NULL")
    got = con.sql(license_scan.ORACLE).project(", ".join(COLUMNS)).fetchall()
    for a, b in zip(sorted(got, key=str), plain([r for r in written() if r[0] != 406]), strict=True):
        assert a == b


def test_spans_of_a_text(spark):
    text = f"one two {TEXTS[6][2]} three {TEXTS[6][2]} mit license"
    found = license_scan.hits(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = sorted((r["label"], r["start"], r["share"]) for r in license_scan.spans(found).collect())
    size = len(split(TEXTS[6][2]))
    assert got == [("mit", 2, 1.0), ("mit", 3 + size, 1.0), ("mit", 3 + 2 * size, 1.0)]


def test_of_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
