"""N-gram Jaccard join: which documents share nearly all their word n-grams.

Rare-first prefix filtering. A document's n-grams are put in one global order,
rarest first. With a similarity of t or more two sets of n-grams must have an
n-gram in common among the first n - ceil(t n) + 1 of each, and nearly all n-grams
occur in one document only, so few documents stay in the running:

1. one scan hashes words and n-grams; documents with equal sets form one class.
   Each chunk of documents gives its postings (n-gram, class) once per class, as
   sorted and compressed arrays, dealt by n-gram;
2. there the documents of each n-gram are counted, exactly and over all
   documents, and n-grams that two or more classes have go back to their classes;
3. a class with too many n-grams of its own is out; the others get prefixes;
4. classes are joined on prefix n-grams, first each with one pivot per n-gram (one
   with the fewest n-grams of its own, so a central one of its group) and only
   then, where a bucket isn't one component yet, with each other across
   components. Length and positional filters look only at a class's size and at
   how many n-grams it has left, so they are applied to the bucket's cells of
   equal sizes and rests first, and only classes of cells that pass meet: a
   template that very many documents fill in without being alike costs a few
   pairs of cells. A suffix filter comes before a pair is verified, once, on all
   n-grams. This finds components, not all links; to find every link, all
   classes of cells that pass meet, those of large cells in salted shares, and
   each pair that the filters leave is verified;
5. components come from contracting links by each class's least neighbour.

An n-gram that LOCAL_HOT classes of one chunk have counts as the most frequent
kind, and its postings skip step 2; so no task there gets more than LOCAL_HOT
postings of an n-gram from any chunk. The order among n-grams only has to be the
same for all, so this changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, give_back, materialise, shuffle_partitions
from .packed import loosen, loosen_sorted, squeeze, squeeze_sorted

LOCAL_HOT = 64
#: Postings that a scanning task holds at once.
CHUNK = 1_000_000
#: UTF-8 bytes of text whose postings one part holds, about.
PART = 8 << 20
#: Bits of an n-gram's hash that postings carry.
BITS = 48
#: Rank of n-grams that are hot in some chunk.
HOT = (1 << 62) - 1
#: Bins by which the suffix filter compares what two sets have behind their first common n-gram.
BINS = 16
#: Classes of one cell that a share has where cells meet.
SHARE = 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_keys() -> Remembered:
    return Remembered(xxhash.xxh64_intdigest, 100_000)


def ngrams(text: str | None, n: int, keys: Remembered) -> np.ndarray:
    """Hashes of the distinct word n-grams, sorted; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    ids = np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))
    if not len(ids):
        return ids
    k = min(n, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _MUL[0] + ids[i : len(ids) - k + 1 + i] * _MUL[1])
    return np.unique(h)


_ROW = "kind string, part int, id string, n int, cls long, tokens binary, at binary, classes binary, sizes binary, ranks binary"
_COLS = [c.split()[0] for c in _ROW.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(c, _KINDS[k]) for c, k in map(str.split, _ROW.split(", "))])


def _rows(**columns) -> pd.DataFrame:
    # No nulls among numbers: pandas would turn longs into doubles.
    out = pd.DataFrame({"n": 0, "cls": -1} | columns)
    for c in _COLS:
        if c not in out:
            out[c] = None
    return out[_COLS]


def _of_lists(rows: list[tuple], *names: str) -> pd.DataFrame:
    return _rows(**{c: [r[k] for r in rows] for k, c in enumerate(names)})


def _scan(n: int, parts: int):
    def flush(sets: dict[int, np.ndarray]) -> list[pd.DataFrame]:
        classes = np.fromiter(sets, np.int64, len(sets))
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        if not len(classes):
            return []
        token = np.concatenate(list(sets.values())) >> np.uint64(64 - BITS)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        many = np.diff(np.append(first, len(token)))
        hot = np.repeat(many >= LOCAL_HOT, many)
        part = (token * np.uint64(parts) >> np.uint64(BITS)).astype(np.int64)  # ascending, as token is
        rows = []
        some_t, some_o = token[~hot], owner[~hot]
        edge = np.searchsorted(part[~hot], np.arange(parts + 1))
        for p in range(parts):
            lo, hi = edge[p], edge[p + 1]
            if lo < hi:
                used, at = np.unique(some_o[lo:hi], return_inverse=True)
                rows.append(("post", p, squeeze_sorted(some_t[lo:hi]), squeeze(at.astype("<u2" if len(used) < 1 << 16 else "<u4")), squeeze(classes[used]), squeeze(sizes[used].astype("<u4"))))
        flags = token[first[many >= LOCAL_HOT]]
        for p in np.unique(flags * np.uint64(parts) >> np.uint64(BITS)):
            rows.append(("flag", int(p), squeeze_sorted(flags[(flags * np.uint64(parts) >> np.uint64(BITS)) == p]), b"", b"", b""))
        hot_t, hot_o = token[hot], owner[hot]
        dealt = classes[hot_o] % parts
        for p in np.unique(dealt):
            own = dealt == p
            used, at = np.unique(hot_o[own], return_inverse=True)
            rows.append(("hot", int(p), squeeze_sorted(hot_t[own]), squeeze(at.astype("<u2" if len(used) < 1 << 16 else "<u4")), squeeze(classes[used]), squeeze(sizes[used].astype("<u4"))))
        return [_of_lists(rows, "kind", "part", "tokens", "at", "classes", "sizes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held = word_keys(), {}, 0
        packed = lambda out: pa.RecordBatch.from_pandas(out, schema=_ARROW, preserve_index=False)
        for batch in batches:
            size, cls = [], []
            for text in batch.column(1):  # one text at a time is a Python object
                grams = ngrams(text.as_py(), n, keys)
                size.append(len(grams))
                if not len(grams):
                    cls.append(-1)
                    continue
                c = xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1
                cls.append(c)
                if c not in sets:
                    sets[c] = grams
                    held += len(grams)
                    if held >= CHUNK:
                        yield from map(packed, flush(sets))
                        sets, held = {}, 0
            # Dealt evenly: a class may have very many documents.
            yield packed(_rows(kind="doc", part=np.arange(batch.num_rows) % parts, id=batch.column(0).to_pandas().to_numpy(), n=size, cls=np.array(cls, np.int64)))
        yield from map(packed, flush(sets))
        sets.clear()
        keys.clear()
        keys.old.clear()
        give_back()

    return run


def _unpack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, class and class size of each posting."""
    token, cls, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for t, a, c, s in zip(rows["tokens"], rows["at"], rows["classes"], rows["sizes"], strict=True):
        every = loosen(c, "<i8")
        at = loosen(a, "<u2" if len(every) < 1 << 16 else "<u4")
        token.append(loosen_sorted(t))
        cls.append(every[at])
        size.append(loosen(s, "<u4")[at].astype(np.int32))
    return np.concatenate(token), np.concatenate(cls), np.concatenate(size)


def _count(parts: int):
    """Send n-grams of two or more classes back to their classes, with their counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        token, cls, size = _unpack(rows[rows["kind"] == "post"])
        flags = [loosen_sorted(t) for t in rows.loc[rows["kind"] == "flag", "tokens"]]
        order = np.lexsort((cls, token))
        token, cls, size = token[order], cls[order], size[order]
        rank = np.empty(0, np.int64)
        if len(token):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
            token, cls, size = token[new], cls[new], size[new]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            many = np.diff(np.append(first, len(token)))
            rank = np.repeat(many, many).astype(np.int64)
            if flags:
                rank[np.isin(token, np.concatenate(flags))] = HOT
            keep = rank > 1
            token, cls, size, rank = token[keep], cls[keep], size[keep], rank[keep]
        dealt, out = cls % parts, []
        order = np.argsort(dealt, kind="stable")
        edge = np.searchsorted(dealt[order], np.arange(parts + 1))
        for p in range(parts):
            own = order[edge[p] : edge[p + 1]]
            if len(own):
                out.append(("shared", p, squeeze_sorted(token[own]), squeeze(cls[own]), squeeze(size[own]), squeeze(rank[own])))
        give_back()
        kept = rows.loc[rows["kind"].isin(("doc", "hot")), _COLS]
        return kept if not out else pd.concat([kept.astype(object), _of_lists(out, "kind", "part", "tokens", "classes", "sizes", "ranks").astype(object)])

    return run


_FOUND = "kind string, id string, cls long, n int, own int, prefix int, tokens array<long>, hist array<int>"


def _prefixes(num: int, den: int):
    """Classes that may have a partner (kind run): n-grams in the global order, and prefix lengths; doc rows pass."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        back = rows[rows["kind"] == "shared"]
        token, cls, size = _unpack(rows[rows["kind"] == "hot"])
        rank = [np.full(len(token), HOT)]
        token, cls, size = [token], [cls], [size]
        for t, c, s, r in zip(back["tokens"], back["classes"], back["sizes"], back["ranks"], strict=True):
            token.append(loosen_sorted(t))
            cls.append(loosen(c, "<i8"))
            size.append(loosen(s, "<i4"))
            rank.append(loosen(r, "<i8"))
        token, cls, size, rank = map(np.concatenate, (token, cls, size, rank))
        order = np.lexsort((token, rank, cls))
        token, cls, size = token[order], cls[order], size[order]
        if len(cls):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
            token, cls, size = token[new], cls[new], size[new]
        first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))) if len(cls) else np.empty(0, np.int64)
        out = []
        for lo, hi in zip(first, np.append(first[1:], len(cls))):
            n, shared = int(size[lo]), int(hi - lo)
            least = -(-num * n // den)
            if shared >= least:
                grams = token[lo:hi].astype(np.int64)
                hist = np.bincount(grams & (BINS - 1), minlength=BINS).astype(np.int32)
                out.append(("run", None, int(cls[lo]), n, n - shared, n - least + 1 - (n - shared), grams, hist))
        give_back()
        names = [c.split()[0] for c in _FOUND.split(", ")]
        docs = rows.loc[rows["kind"] == "doc", ["kind", "id", "cls", "n"]].assign(own=0, prefix=0, tokens=None, hist=None)[names]
        return docs if not out else pd.concat([docs.astype(object), pd.DataFrame(out, columns=names).astype(object)])

    return run


def components(edges: DataFrame, tag: str) -> DataFrame | None:
    """(node, root) for each node of edges (a, b): the least node it reaches; None without edges.

    Each turn maps a node to the least node next to it, and that one's once more,
    and contracts the edges by this; those within a component vanish. A
    component's least node maps to itself, so it is what remains.
    """
    edge = lambda df: df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, roots = materialise(edge(edges), tag + "-edges"), None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), tag + "-up")
        twice = up.join(up.select(F.col("node").alias("n"), F.col("up").alias("root")), F.col("up") == F.col("n")).select("node", "root")
        twice = materialise(twice, tag + "-up")
        to = lambda c: twice.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))  # noqa: B023, E731
        if roots is None:
            roots = twice
        else:
            roots = materialise(roots.join(to("x"), F.col("root") == F.col("n_x"), "left").select("node", F.coalesce("r_x", "root").alias("root")), tag + "-roots")
        met = left.join(to("a"), F.col("a") == F.col("n_a")).join(to("b"), F.col("b") == F.col("n_b"))
        left = materialise(edge(met.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))), tag + "-edges")
    return roots


def _enough(num: int, den: int, most: Column, na: str, nb: str) -> Column:
    """Whether `most` common n-grams could be enough for sets of these sizes."""
    return most * (num + den) >= num * (F.col(na) + F.col(nb))


def join(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their components, and the verified links.

    The first result has a row for each row of docs: id_col, n_shingles (distinct
    n-grams of the lower-cased words; a text with fewer words counts as one),
    cls (its class of equal n-gram sets) and component_id, the least id that links
    of at least similarity[0] / similarity[1] reach. The second has pairs of
    class representatives (a, b) that were verified as links: enough of them to
    connect each component, not all pairs within one. With `every` it has all pairs
    of classes that are links, and the first result also n_links: how many other
    rows a row links with, those of its own class included. Their number, and so the work, grows
    with the square of a group of near copies.

    A null, empty or all-white text has no n-grams, links with nothing and is its
    own component, with cls null. A null id takes part in linking, but is no
    component's id unless it has no other. Equal texts have the same class, and
    repeated rows each get a row. Very long texts are read whole. An empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    num, den = similarity
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // PART))
    scanned = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_scan(n, parts), _ROW)
    counted = scanned.groupBy("part").applyInPandas(_count(parts), _ROW)
    # Postings are on disk only as these two shuffles' files.
    found = materialise(counted.groupBy("part").applyInPandas(_prefixes(num, den), _FOUND), "join-found")
    running = found.where("kind = 'run'").select("cls", "n", "own", "prefix", "tokens", "hist")
    prefix = materialise(
        running.select("cls", "n", "own", F.posexplode(F.slice("tokens", 1, F.col("prefix"))).alias("k", "token")).withColumn("rest", F.expr("n - own - k")), "join-prefix"
    )

    def fitting() -> Column:
        """Length and positional filter: at a pair's first common n-gram no more than the smaller rest can be common.

        At later ones the bound only falls, so it may cut those rows too: the first one brings the pair.
        """
        length = F.least("n_x", "n_y") * den >= num * F.greatest("n_x", "n_y")
        return length & _enough(num, den, F.least("rest_x", "rest_y"), "n_x", "n_y")

    def side(df: DataFrame, s: str, *names: str) -> DataFrame:
        return df.select("token", *[F.col(c).alias(f"{c}_{s}") for c in names])

    def pair(df: DataFrame) -> DataFrame:
        swap = F.col("cls_x") > F.col("cls_y")
        k = lambda s, t: F.when(swap, F.col(f"k_{s}")).otherwise(F.col(f"k_{t}"))
        return df.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b"), k("y", "x").alias("ka"), k("x", "y").alias("kb"))

    def with_pivots(rooted: DataFrame, pivots: DataFrame) -> DataFrame:
        """Pairs of each class and its bucket's pivot, if they are of different components."""
        names = ("cls", "n", "rest", "k", "root")
        return pair(side(rooted, "x", *names).join(side(pivots, "y", *names), "token").where((F.col("root_x") != F.col("root_y")) & fitting()))

    def with_all(rooted: DataFrame) -> DataFrame:
        """Pairs of classes of one bucket and different roots, by cells that pass the filters."""
        cells = rooted.groupBy("token", "n", "rest").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        cells = materialise(cells.withColumn("shares", F.ceil(F.col("m") / SHARE).cast("int")), "join-cells")
        names = ("n", "rest", "lo", "hi", "shares")
        met = side(cells, "x", *names).join(side(cells, "y", *names), "token")
        # Each two cells once; a cell of several classes also meets itself.
        ordered = F.struct("n_x", "rest_x") <= F.struct("n_y", "rest_y")
        apart = (F.col("lo_x") != F.col("hi_x")) | (F.col("lo_y") != F.col("hi_y")) | (F.col("lo_x") != F.col("lo_y"))
        met = met.where(ordered & apart & fitting())
        met = materialise(met.select("token", "n_x", "rest_x", "n_y", "rest_y", F.explode(F.sequence(F.lit(0), F.col("shares_x") - 1)).alias("share_x"), "shares_y"), "join-met")
        met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("shares_y") - 1)).alias("share_y"))
        dealt = rooted.join(cells.select("token", "n", "rest", "shares"), ["token", "n", "rest"]).withColumn("share", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int"))
        dealt = materialise(dealt.select("token", "n", "rest", "share", "cls", "k", "root"), "join-dealt")
        x, y = (side(dealt, s, "n", "rest", "share", "cls", "k", "root") for s in "xy")
        both = x.join(met, ["token", "n_x", "rest_x", "share_x"]).join(y, ["token", "n_y", "rest_y", "share_y"])
        same = (F.col("n_x") == F.col("n_y")) & (F.col("rest_x") == F.col("rest_y"))
        return pair(both.where((F.col("root_x") != F.col("root_y")) & (~same | (F.col("cls_x") < F.col("cls_y")))))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs that go through positional and suffix filter at their first common n-gram, and those of them that link."""
        once = pairs.groupBy("a", "b").agg(F.min("ka").alias("ka"), F.min("kb").alias("kb"))
        if seen is not None:
            once = once.join(seen, ["a", "b"], "left_anti")
        whole = lambda s: running.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "tokens")])
        small = lambda s: running.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "own", "hist")], F.slice("tokens", 1, F.col("prefix")).alias(f"head_{s}"))
        first = F.least(F.expr("n_a - own_a - ka"), F.expr("n_b - own_b - kb"))
        # What either set has in each bin from its first common n-gram on.
        suffix = lambda s: F.transform(f"hist_{s}", lambda h, i: h - F.size(F.filter(F.slice(f"head_{s}", 1, F.col(f"k{s}")), lambda t: t.bitwiseAND(BINS - 1) == i)))
        common = F.aggregate(F.zip_with(suffix("a"), suffix("b"), lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
        once = once.join(small("a"), F.col("a") == F.col("cls_a")).join(small("b"), F.col("b") == F.col("cls_b"))
        once = materialise(once.where(_enough(num, den, first, "n_a", "n_b")).where(_enough(num, den, common, "n_a", "n_b")).select("a", "b"), "join-pairs")
        both = once.join(whole("a"), F.col("a") == F.col("cls_a")).join(whole("b"), F.col("b") == F.col("cls_b"))
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return once, both.where(_enough(num, den, common, "n_a", "n_b")).select("a", "b")

    roots, links, seen = materialise(running.select("cls", F.col("cls").alias("root")), "join-roots"), None, None
    for seed in (0,) if every else (1, 2, 0):
        rooted = prefix.join(roots, "cls")
        # Buckets that are one component have nothing left to find.
        pivot = F.min_by(F.struct("cls", "n", "rest", "k", "root"), F.struct("own", F.xxhash64("cls", F.lit(seed))))
        open_ = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pivot.alias("pivot")).where("lo != hi")
        if seed:
            pairs = with_pivots(rooted, open_.select("token", "pivot.*"))
        else:
            pairs = with_all(materialise(rooted.join(open_.select("token"), "token", "left_semi"), "join-left"))
        once, new = verified(pairs)
        new = materialise(new, "join-links")
        # With pivots a pair may be looked at, and cut, behind its first common n-gram; only what was verified counts as seen.
        seen = once if seen is None else seen.unionByName(once)
        links = new if links is None else links.unionByName(new)
        at = lambda c: roots.select(F.col("cls").alias(f"c_{c}"), F.col("root").alias(f"r_{c}"))  # noqa: B023, E731
        met = new.join(at("a"), F.col("a") == F.col("c_a")).join(at("b"), F.col("b") == F.col("c_b"))
        joined = components(met.select(F.col("r_a").alias("a"), F.col("r_b").alias("b")), "join")
        if joined is not None:
            after = roots.join(joined.select("node", F.col("root").alias("to")), F.col("root") == F.col("node"), "left")
            roots = materialise(after.select("cls", F.coalesce("to", "root").alias("root")), "join-roots")

    rows = found.where("kind = 'doc'").select(F.col("id").cast(kind).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls") >= 0, F.col("cls")).alias("cls"))
    least = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min(id_col).alias("least")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = materialise(least, "join-least")
    lowest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(least.join(lowest, "root").select("cls", "component_id"), "join-named")
    columns = [id_col, "n_shingles", "cls", "component_id"]
    if every:
        sizes = materialise(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("size")), "join-sizes")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(sizes, F.col("b") == F.col("cls")).groupBy("a").agg(F.sum("size").alias("near"))
        counts = sizes.join(near, F.col("cls") == F.col("a"), "left").select("cls", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
        named, columns = materialise(named.join(counts, "cls"), "join-named"), [*columns, "n_links"]
    # Empty sets would all meet in one task of the join.
    out = rows.where("cls IS NOT NULL").join(named, "cls").select(columns)
    empty = rows.where("cls IS NULL").withColumns({"component_id": F.col(id_col), "n_links": F.lit(0).cast("long")}).select(columns)
    return out.unionByName(empty), links


#: The same in SQL, for 3 words and 90 %.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN list_filter([array_to_string(ws, ' ')], lambda x: x <> '')
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
