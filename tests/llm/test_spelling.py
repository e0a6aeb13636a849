"""Variants of words against plain Python and SQL, with odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def changed(word):
    """All that one inserted, deleted or replaced letter makes of a word, letters being those that occur."""
    letters = "abcdefghijklmnopqrstuvwxyzàéßÉÿ×"
    for i in range(len(word) + 1):
        yield from (word[:i] + x + word[i:] for x in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + x + word[i + 1 :] for x in letters)


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: {x for x in changed(w) if x in n and x != w} for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def written():
    rng = random.Random(8)
    rows = []
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(12)]
    for w in list(base):
        base += rng.sample(sorted(changed(w)), 25)
    rows += [(i, " ".join(rng.choice(base) for _ in range(200))) for i in range(40)]
    rows += [(100 + i, "aaaaaaa aaaaaaaa aaaaaaaaa abababab babababa bababab") for i in range(9)]  # several ways from one to another
    rows += [(200 + i, "Common COMMONLY commonly, commonly\ncommonly ") for i in range(300)]
    rows += [(600, "commonli commonli " + "commmonli " * 2), (601, "commonli " * 30), (602, "commonlii commonlii")]
    rows += [(700 + i, "prefix" + x) for i in range(2) for x in ["ab", "ac", "b", "bc", "abc", "acb", "ÀÉ", "àé", "×", "ß", "ÿÿÿ", "abcd", "abce", "xbcd"]]
    rows += [(800, "y" * 30_000 + " " + "y" * 30_000), (801, "y" * 29_999 + " " + "y" * 29_999), (802, "z" * 400 + "q" + "z" * 400), (803, "z" * 400 + "q" + "z" * 400), (804, "z" * 800), (805, "z" * 800)]
    rows += [(None, "without an id without without"), (None, "without"), (900, None), (901, ""), (902, "sixsix 中文 sevenˆ1234567 seven_letters letters")] + [(903, "repeated rows")] * 4
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(written(), "doc_id long, text string")
    return rows.withColumns({"word": F.lit("clash"), "n": F.lit("clash"), "run": F.lit(None), "key": F.lit(1)}).repartition(4)


def collected(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("most", [spelling.GROUP, 20, 1])
def test_as_plain_python(docs, most):
    longest = 100_000 if most > 20 else 2000  # stretches of one letter are many in very long words
    got = collected(spelling.variants(docs.where(f"text IS NULL OR length(text) < {longest}"), most=most))
    want = plain([r for r in written() if len(r[1] or "") < longest])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert got == want
    by_word = {r[0]: r for r in got}
    assert by_word["commonli"][1:3] == ("commonly", "commonly")
    assert any(r[1] and r[2] != r[1] for r in got) and len(got) > 200  # one way has two steps


def test_sql_says_the_same(docs):
    some = docs.where(F.length("text") < 10_000).select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("frame", some)
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    got = con.sql(spelling.ORACLE).project(", ".join(COLUMNS)).fetchall()
    assert sorted(got) == plain([r for r in written() if len(r[1] or "") < 10_000])


def test_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "once upon seventy"), (2, None)], none.schema)).count() == 0


def test_groups_are_bounded(docs):
    vocabulary = spelling.words(docs.where("length(text) < 2000"))
    for backward in (False, True):
        parts = spelling._groups(vocabulary, backward, 5)
        assert len(parts) > 2
        for rows in parts:
            sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("b") - F.col("a")).alias("stretch"))
            assert sizes.where("words > 5 AND stretch > 1").count() == 0


def test_automaton_numbers_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(300)})
    found = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = found.root, 0
        for letter in w:
            edge, ok = found.step(spelling.np.array([state]), spelling.np.array([letter]))
            assert ok.all()
            state, number = int(found.target[edge[0]]), number + int(found.skipped[edge[0]])
        assert found.final[state] and number == k
    suffixes = {tuple(w[len(p) :] for w in words if w.startswith(p)) for v in words for p in (v[:i] for i in range(len(v) + 1))}
    assert len(found.final) == len(suffixes)  # no two states have the same continuations
