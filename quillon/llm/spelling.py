"""Spelling variants: words of a corpus that differ by one letter, and what they are variants of.

A single insertion, deletion or replacement lies in one half of a word, so the
other half stands in both words unchanged. Words that share their first letters
go to one task, which holds them as a minimal acyclic automaton whose paths number
the words in order (a perfect hash): each word is followed exactly through its
first half, and then completed with one error. Words that share their last
letters do the same in an automaton of reversed words, for errors in the first half.

Where a word may be changed in several ways into another one, the first place at
which the two differ counts: the half that holds it, and only that, gives the
pair. So no pair is found twice, and the tasks send counts and best candidates
instead of pairs.

A beginning or ending that very many words have is split: by length and exact
half first, then by halving the stretch in which the error may lie, until all
groups are small. With a stretch of one letter a group has some thousand words at
most, as only so many letters exist; so no group is ever too large for a task.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Fewest code points of a word, and fewest occurrences.
SHORTEST, RAREST = 7, 2
#: One in so many occurrences is changed.
CHANGED = 31
#: How much more frequent a word's form must be.
TIMES = 10
#: Words that a group may have before it is split, and that an automaton is made for if groups are small.
GROUP = 20_000
#: Letters for which small groups share an automaton at most.
LETTERS = 1 << 21
#: Words that are followed at a time.
ABREAST = 4096
#: Letters with which two halves of the shortest word begin and end.
HEAD, TAIL = SHORTEST // 2, SHORTEST - SHORTEST // 2


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of all texts, some of them changed, that are long and frequent enough."""
    small = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    # A run that is too short stays so, and a match takes all letters of its run.
    runs = F.regexp_extract_all(small, F.lit(f"([a-zÀ-ÿ]{{{SHORTEST},}})"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    each = docs.select(name.alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    each = each.withColumn("h", h).select(F.when(F.col("h") % CHANGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return each.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RAREST)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; the number of a word is its place among them."""

    def __init__(self, sorted_words: list[bytes]):
        flat = np.frombuffer(b"".join(sorted_words), np.uint8)
        size = np.fromiter(map(len, sorted_words), np.int64, len(sorted_words))
        start = np.cumsum(size) - size
        live, at, depth, levels = np.arange(len(size)), np.zeros(len(size), np.int64), 0, []
        while len(live):  # the trie, a level at a time
            under = np.bincount(at)
            ends = size[live] == depth
            final = np.zeros(len(under), bool)
            final[at[ends]] = True
            live, at = live[~ends], at[~ends]
            letter = flat[start[live] + depth]
            new = np.ones(len(live), bool)
            new[1:] = (at[1:] != at[:-1]) | (letter[1:] != letter[:-1])
            levels.append((under, final, at[new], letter[new]))
            at, depth = np.cumsum(new) - 1, depth + 1
        known: dict[bytes, int] = {}  # states by what follows from them; those that are reached have lower numbers
        numbers, counts = np.zeros(0, np.int64), []
        for under, final, parent, letter in reversed(levels):
            raw = (letter.astype(np.int64) << 40 | numbers).tobytes()
            bounds = 8 * np.searchsorted(parent, np.arange(len(under) + 1))
            marks = np.where(final, 1, 0).tolist()
            numbers = np.array([known.setdefault(raw[a:b] + b"\1" * f, len(known)) for a, b, f in zip(bounds[:-1].tolist(), bounds[1:].tolist(), marks)], np.int64)
            counts.append((numbers, under))
        self.root = int(numbers[0])
        self.final = np.fromiter((len(s) % 8 == 1 for s in known), bool, len(known))
        degree = np.fromiter((len(s) // 8 for s in known), np.int64, len(known))
        edges = np.frombuffer(b"".join(s[: len(s) // 8 * 8] for s in known), np.int64)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        self.letter, self.target = edges >> 40, edges & ((1 << 40) - 1)
        below = np.zeros(len(known), np.int64)
        for state, under in counts:
            below[state] = under
        source = np.repeat(np.arange(len(known)), degree)
        before = np.cumsum(below[self.target]) - below[self.target]
        self.skipped = before - before[self.first[source]] + self.final[source]  # words that come before those behind an edge
        self.keys = source * 256 + self.letter

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges, and whether they are there."""
        key = state * 256 + letter
        edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return edge, self.keys[edge] == key

    def follow(self, text, q, state, number, place, until):
        """All (q, state, number, place) that get through their word to until[q]."""
        done = []
        while len(q):
            there = place == until[q]
            if there.any():
                done.append((q[there], state[there], number[there], place[there]))
                q, state, number, place = q[~there], state[~there], number[~there], place[~there]
            edge, ok = self.step(state, text(q, place))
            q, edge, number, place = q[ok], edge[ok], number[ok], place[ok]
            state, number, place = self.target[edge], number + self.skipped[edge], place + 1
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 4

    def one_error(self, text, size, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """(number of query, number of word), once each, for words that differ by one error within begin..end of the query."""
        none = np.zeros(len(size), np.int64)
        q, state, number, place = self.follow(text, np.arange(len(size)), none + self.root, none, none, begin)
        found = []
        while len(q):
            degree = self.first[state + 1] - self.first[state]
            of = np.repeat(np.arange(len(q)), degree)
            edge = np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree, degree) + self.first[state][of]
            more = place < end[q]
            letter = np.where(more, text(q, np.where(more, place, 0)), -1)
            other = more[of] & (self.letter[edge] != letter[of])
            behind = self.target[edge], number[of] + self.skipped[edge]
            found.append((q[of], *behind, place[of]))  # a letter more in the other word
            found.append((q[of][other], behind[0][other], behind[1][other], place[of][other] + 1))  # another letter
            q, state, number, place = q[more], state[more], number[more], place[more]
            found.append((q, state, number, place + 1))  # a letter less
            edge, ok = self.step(state, letter[more])
            q, number, place, state = q[ok], number[ok] + self.skipped[edge[ok]], place[ok] + 1, self.target[edge[ok]]
        q, state, number, _ = self.follow(text, *(np.concatenate(x) for x in zip(*found, strict=True)), size)
        ends = self.final[state]
        both = np.unique(np.stack([q[ends], number[ends]], 1), axis=0) if ends.any() else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]


class _Flat:
    """Words as one array of letters; a word may be read from its end."""

    def __init__(self, of: list[bytes]):
        self.letters = np.frombuffer(b"".join(of), np.uint8)
        self.size = np.fromiter(map(len, of), np.int64, len(of))
        self.start = np.cumsum(self.size) - self.size

    def at(self, which, place):
        return self.letters[self.start[which] + place].astype(np.int64)


#: Columns of a group's rows, and of what is found in it.
ROWS = ("key", "word", "n", "asks", "a", "b")
FOUND = "word string, n_near long, form string, form_n long"


def _best(rows: list[tuple[np.ndarray, ...]], backward: bool) -> pa.RecordBatch:
    """How many words are near each query of the groups in rows (ROWS), and the most frequent one."""
    _, word, n, asks, a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
    turn = slice(None, None, -1) if backward else slice(None)
    held = dict(zip(word.tolist(), n.tolist(), strict=True))
    dictionary = sorted(w[turn] for w in held)
    automaton, all_words = Automaton(dictionary), _Flat(dictionary)
    straight = [w[turn] for w in dictionary]
    often = np.fromiter((held[w] for w in straight), np.int64, len(straight))
    order = np.empty(len(straight), np.int64)
    order[sorted(range(len(straight)), key=straight.__getitem__)] = np.arange(len(straight))
    queries, out = np.flatnonzero(asks), []
    for low in range(0, len(queries), ABREAST):
        some = queries[low : low + ABREAST]
        flat = _Flat([w[turn] for w in word[some].tolist()])
        begin, end = a[some], b[some]
        q, near = automaton.one_error(flat.at, flat.size, *((flat.size - end, flat.size - begin) if backward else (begin, end)))
        # The first letter that differs must lie before the end; where the end is the word's, it does.
        differs = end[q] == flat.size[q]
        for k in range(int((end - begin).max(initial=0))):
            open_ = np.flatnonzero(~differs & (begin[q] + k < end[q]))
            place = begin[q[open_]] + k
            one = (flat.size[q[open_]] - 1 - place, all_words.size[near[open_]] - 1 - place) if backward else (place, place)
            differs[open_] = flat.at(q[open_], one[0]) != all_words.at(near[open_], one[1])
        q, near = q[differs], near[differs]
        rank = np.lexsort((order[near], -often[near], q))
        who, first, count = np.unique(q[rank], return_index=True, return_counts=True)
        best = near[rank][first]
        names = [[w.decode("latin-1") for w in some_words] for some_words in (word[some][who].tolist(), [straight[i] for i in best])]
        out.append((names[0], count, names[1], often[best]))
    columns = [[v for x in some for v in x] for some in zip(*out, strict=True)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n_near", "form", "form_n"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    columns = {name: batch.column(name) for name in ROWS}
    words = np.empty(batch.num_rows, object)
    words[:] = [w.encode("latin-1") for w in columns["word"].to_pylist()]
    return tuple(words if name == "word" else c.to_numpy(zero_copy_only=False) for name, c in columns.items())


def _search(backward: bool, most: int):
    """Searches within groups that come one after the other; small ones share an automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, count, last = [], 0, 0, None
        for batch in batches:
            rows = _arrays(batch)
            low = 0
            for at, (key, word) in enumerate(zip(rows[0].tolist(), rows[1].tolist(), strict=True)):
                if key != last and (count >= most or letters >= LETTERS):
                    yield _best([*held, tuple(x[low:at] for x in rows)], backward)
                    held, letters, count, low = [], 0, 0, at
                letters, count, last = letters + len(word), count + 1, key
            held.append(tuple(x[low:] for x in rows))
        if count:
            yield _best(held, backward)

    return run


def _key(a: Column, b: Column, asked: Column, *more: Column) -> Column:
    """Hash of what a word has outside letters a to b of a word that is `asked` letters long; where two meet, groups do, and no more."""
    word = F.col("word")
    return F.xxhash64(*more, F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - (asked - b) + 1, asked - b))


def _stretches(rows: DataFrame, backward: bool) -> DataFrame:
    """rows (word, n, asked, pieces, piece) with the stretch a to b in which words of `asked` letters may differ, and the key that they share."""
    half, asked = F.floor(F.col("asked") / 2), F.col("asked")
    low, size = (F.lit(0), half) if backward else (half, asked - half)
    bound = lambda i: (low + F.floor(size * i / F.col("pieces"))).cast("int")
    rows = rows.withColumns({"a": bound(F.col("piece")), "b": bound(F.col("piece") + 1)}).where("a < b")
    return rows.withColumns({"asks": asked == F.length("word"), "key": _key(F.col("a"), F.col("b"), asked, asked, F.col("pieces"), F.col("piece"))})


def _groups(vocabulary: DataFrame, backward: bool, most: int) -> list[DataFrame]:
    """Rows (key, word, n, asks, a, b): words that share a key are compared; no group with a stretch of several letters has more than `most` words."""
    word, size = F.col("word"), F.length("word")
    half = F.floor(size / 2).cast("int")
    share = F.substring(word, size - TAIL + 1, F.lit(TAIL)) if backward else F.substring(word, 1, HEAD)
    rows = vocabulary.select("word", "n", F.lit(True).alias("asks"), (F.lit(0) if backward else half).alias("a"), (half if backward else size).alias("b"), F.xxhash64(share).alias("key"))
    done, first = [], True
    while True:
        large = rows.where("b > a + 1").groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most).select("key")
        large = materialise(large, "spelling-large")
        if not large.limit(1).count():
            return [*done, rows.select(*ROWS)]
        done.append(rows.join(large, "key", "left_anti").select(*ROWS))
        split = rows.join(large, "key", "left_semi")
        if first:
            asked = F.explode(F.filter(F.array(size - 1, size, size + 1), lambda x: x >= SHORTEST))
            split = split.select("word", "n", asked.alias("asked"), F.lit(1).alias("pieces"), F.lit(0).alias("piece"))
        else:
            halves = F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1))
            split = split.select("word", "n", "asked", (F.col("pieces") * 2).alias("pieces"), halves.alias("piece"))
        rows, first = materialise(_stretches(split, backward), "spelling-stretches"), False


def near(vocabulary: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n_near, form, form_n): words of vocabulary (word, n) that have near ones, and the most frequent of these (ties: least in code-point order)."""
    found = None
    n = shuffle_partitions(vocabulary.sparkSession)
    for backward in (False, True):
        for rows in _groups(vocabulary, backward, most):
            some = rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_search(backward, most), FOUND)
            found = some if found is None else found.unionByName(some)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each time."""
    roots = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(further, "root", "left_semi").limit(1).count():
            return roots
        roots = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = GROUP) -> DataFrame:
    """A row for each word: its near words, the form of which it is a variant, and that form's last form.

    Words are runs of letters (A to Z and U+00C0 to U+00FF, A to Z in lower case) of
    SHORTEST code points or more that occur RAREST times or more in all texts. One in
    CHANGED occurrences, by the crc32 of `id:run`, has lost a code point before it is counted.

    Returns word, form, root, n, n_near and form_n. Two words are near if one inserted,
    deleted or replaced code point makes one of the other. The form is the near word
    of largest n, of those that tie the least in code-point order, if that n is
    TIMES the word's or more; else form and form_n are null and the word is its own
    root. As n grows from form to form, the way to the root ends.

    A null or empty text has no words; a null id counts as an empty one; repeated rows count each. Very
    long texts are read whole, and words may be of any length. An empty table gives
    no rows, and other columns are ignored, whatever their names. `most` bounds the
    words of a group, which a task compares at a time; it changes no result.
    """
    vocabulary = materialise(words(docs, id_col, text_col), "spelling-words")
    known = vocabulary.join(near(vocabulary, most), "word", "left")
    good = F.col("form_n") >= F.col("n") * TIMES
    known = materialise(known.select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = rf"""
WITH RECURSIVE k AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{SHORTEST},}}')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS times FROM r GROUP BY id, run),
h AS (SELECT run, times, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, k),
w AS (SELECT CASE WHEN h % {CHANGED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {RAREST}),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.cut = b.word),
q AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * v.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * v.n THEN form_n END AS form_n FROM v LEFT JOIN q USING (word)),
z AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT z.word, z.next, f.form FROM z JOIN f ON f.word = z.next)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word AND z.next IS NULL
"""
