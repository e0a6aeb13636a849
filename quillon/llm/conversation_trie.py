"""The prefix trie of conversations, built and rolled up level by level.

Conversations that begin with the same turns share the nodes of these turns, so
the saved tokens of a node say what keeping its last turn once would save.

1. turns are numbered within their conversation by one range-partitioned order;
   a conversation of any length is spread over as many ranges as it fills;
2. each conversation is rebuilt: it begins with turns of its block's first one;
3. conversations that are equal turn by turn form one class, which goes through
   the trie as one with the weight of all, named by its least conv_id;
4. going down, the classes that are live at a depth are grouped by (parent node,
   next turn); each group is a node, named by its least conv_id. A class that is
   alone on its node has no one left to be told apart from: all its further turns
   are a chain of nodes, and are written at once after the last level;
5. going up, each level's nodes take the leaves and savings of their children.

So there are as many levels as turns that two different conversations have in
common at most, whatever the length of the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shuffle_partitions

#: Ids of a row that goes to the task which hashes the ends of a node.
CHUNK = 512
#: Turns of a chain that are summed up together.
BLOCK = 4096
#: Code points by which turns that tie are put in order; beyond them the digest decides.
TIE = 64
_NOTHING = hashlib.sha256(b"").hexdigest()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, part, nr, key, chars) in order of nr within the conversation's part, and its parts (conv_id, part, start, before, n).

    A row is number nr - start + before of its conversation, from 0.
    """
    said = F.concat(F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(said, 1, TIE).alias("begins"),
        F.unhex(F.md5(said.cast("binary"))).alias("key"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        # Rows that are equal may stand in any order; this one lets their ranges part.
        F.monotonically_increasing_id().alias("any"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "begins", "key", "any"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialise(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nr"), "key", "chars"), "trie-rows")
    parts = rows.groupBy("conv_id", "part").agg(F.min("nr").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, materialise(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")


def rebuilt(conversations: DataFrame, span: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns (conv_id, depth from 1, key, chars) after rebuilding."""
    rows, parts = numbered(conversations)
    total = parts.groupBy("conv_id").agg(F.sum("n").alias("total"))
    base = F.col("conv_id") - F.col("conv_id") % span
    head = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    own = total.select("conv_id", "total", base.alias("base"), head.cast("long").alias("head"))
    first = total.select(F.col("conv_id").alias("base"), F.col("total").alias("there"))
    taken = F.least("head", F.coalesce("there", F.lit(0)))
    convs = own.join(first, "base", "left").select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("total") - F.col("head"), F.lit(0))).alias("len"))
    convs = materialise(convs, "trie-conversations")
    at = F.col("nr") - F.col("start") + F.col("before")
    placed = rows.join(parts.drop("n"), ["conv_id", "part"]).withColumn("at", at)
    heads = placed.where((F.col("conv_id") % span == 0) & (F.col("at") < most - 1)).select(F.col("conv_id").alias("base"), "at", "key", "chars")
    copied = convs.where("taken > 0").join(heads, "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "key", "chars")
    where = parts.join(convs, "conv_id").drop("n", "base", "len")
    kept = rows.join(where, ["conv_id", "part"]).withColumn("at", at).where("at >= head")
    turns = kept.select("conv_id", (F.col("at") - F.col("head") + F.col("taken") + 1).alias("depth"), "key", "chars").unionByName(copied)
    return convs.select("conv_id", "len"), materialise(turns, "trie-turns")


def _classes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (c, n, len) of equal conversations, and their conversations (conv_id, c) where a class has several.

    A conversation is known by its length and 128 bits: two sums of hashes of its
    turns with their places, so that no task needs all of its turns.
    """
    sums = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("key", "depth")).alias("a"), F.bit_xor(F.xxhash64("depth", "key")).alias("b"))
    named = convs.join(sums, "conv_id", "left").select("conv_id", "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    named = materialise(named, "trie-named")
    classes = materialise(named.groupBy("len", "a", "b").agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")), "trie-classes")
    several = named.join(classes.where("n > 1"), ["len", "a", "b"]).select("conv_id", "c")
    return classes.select("c", "n", "len"), several


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the ids of each class; its chunks come one after the other, in order."""
    c, sha = None, None
    for frame in batches:
        done = []
        for now, ids in zip(frame["c"], frame["ids"], strict=True):
            if now == c:
                sha.update(b",")
            else:
                if c is not None:
                    done.append((c, sha.hexdigest()))
                c, sha = now, hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(done, columns=["c", "sha"])
    if c is not None:
        yield pd.DataFrame([(c, sha.hexdigest())], columns=["c", "sha"])


def _ends(classes: DataFrame, several: DataFrame) -> DataFrame:
    """(c, sha): digest of the sorted ids of each class.

    SHA-256 can't be merged, so one task hashes the ids of one class; they reach
    it as chunks of CHUNK ids that other tasks have sorted and written out, and it holds a batch of them at a time.
    """
    alone = classes.where("n = 1").select("c", F.sha2(F.col("c").cast("string").cast("binary"), 256).alias("sha"))
    n = shuffle_partitions(classes.sparkSession)
    order = several.repartitionByRange(n, "c", "conv_id").sortWithinPartitions("c", "conv_id").withColumn("nr", F.monotonically_increasing_id())
    order = materialise(order, "trie-members").withColumn("nr", F.floor(F.col("nr") / CHUNK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = order.groupBy("c", "nr").agg(ids.alias("ids"))
    dealt = chunks.repartition(n, "c").sortWithinPartitions("c", "nr")
    return alone.unionByName(dealt.mapInPandas(_hash_chunks, "c long, sha string"))


def _suffix_sums(chain: DataFrame) -> DataFrame:
    """chain (c, depth, own, ...) with `saved`, the sum of `own` from this depth of c on; blocks of a chain are summed by themselves."""
    chain = chain.withColumn("block", F.floor(F.col("depth") / BLOCK))
    later = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = chain.groupBy("c", "block").agg(F.sum("own").alias("own")).select("c", "block", F.coalesce(F.sum("own").over(later), F.lit(0)).alias("later"))
    within = Window.partitionBy("c", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return chain.join(blocks, ["c", "block"]).withColumn("saved", F.sum("own").over(within) + F.col("later"))


def _down(classes: DataFrame, paths: DataFrame) -> list[DataFrame]:
    """Nodes (parent, node, n_convs, n_classes, ends, chars, depth) of each level from the root on, while different conversations share nodes."""
    least = classes.agg(F.min("c")).first()[0]
    if least is None:
        return []
    live = classes.withColumn("node", F.lit(least))
    ends = F.max(F.when(F.col("len") == F.col("depth"), F.col("c"))).alias("ends")
    node = [F.min("c").alias("node"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("n_classes"), ends, F.first("chars").alias("chars")]
    root = classes.withColumns({"depth": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")}).groupBy("depth").agg(*node)
    levels = [materialise(root.withColumn("parent", F.lit(None).cast("long")), "trie-nodes")]
    while levels[-1].where("n_classes > 1").limit(1).count():
        depth = len(levels)
        moves = live.where(F.col("len") >= depth).drop("len").withColumnRenamed("node", "parent").join(paths.where(F.col("depth") == depth).drop("n"), "c")
        groups = materialise(moves.groupBy("depth", "parent", "key").agg(*node), "trie-nodes")
        shared = groups.where("n_classes > 1").select("parent", "key", "node")
        live = materialise(moves.join(shared, ["parent", "key"]).select("c", "n", "len", "node"), "trie-live")
        levels.append(groups.drop("key"))
    return levels


def _up(levels: list[DataFrame], below: DataFrame) -> list[DataFrame]:
    """Nodes of all levels with n_children, n_leaves and saved; below: what hangs under nodes that one class has for itself."""
    done, children = [], None
    for depth, nodes in reversed(list(enumerate(levels))):
        own = (F.col("n_convs") - 1) * F.col("chars")
        under = below.where(F.col("depth") == depth).drop("depth").withColumnRenamed("c", "node")
        if children is not None:
            sums = [F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saving")]
            under = under.unionByName(children.groupBy(F.col("parent").alias("node")).agg(*sums))
        got = nodes.join(under, "node", "left")
        children = materialise(
            got.select(
                *("node", "depth", "parent", "n_convs", "ends"),
                F.coalesce("kids", F.lit(0)).alias("n_children"),
                F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                (own + F.coalesce("saving", F.lit(0))).alias("saved"),
            ),
            "trie-rolled",
        )
        done.append(children)
    return done


def trie(conversations: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt conversations.

    conversations has conv_id, turn, role and text. Every conversation begins with
    the first h turns of the one whose id is the next lower multiple of `span`
    (with as many as that has), and goes on with its own turns after its first h;
    h is the crc32 of its id modulo `most`. span=1 leaves all as they are.

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, where a token is a code point of the
    last turn's text. The root has depth 0, no text and no parent.

    A null role or text counts as empty, and a null turn comes first. Turns that
    tie go by the first TIE code points of role and text, then by their MD5;
    repeated rows are turns of their own. A row without a conv_id belongs to no conversation
    and is left out. A conversation that has no turn left ends at the root. Very long texts count whole, and a
    very long conversation is a chain that no task holds. Turns are told apart by
    128 bits of a hash. An empty table gives no nodes, not even a root; other columns
    are ignored, whatever their names.
    """
    convs, turns = rebuilt(conversations, span, most)
    classes, several = _classes(convs, turns)
    paths = materialise(turns.withColumnRenamed("conv_id", "c").join(classes, "c").sortWithinPartitions("depth"), "trie-paths")
    levels = _down(classes, paths)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not levels:
        return classes.select(*[F.lit(None).cast("string" if n == "ends_sha256" else "long").alias(n) for n in names]).where("false")
    solo = _union([x.where("n_classes = 1").select(F.col("node").alias("c"), F.col("depth").alias("top")) for x in levels])
    chain = materialise(paths.join(solo, "c").where("depth > top").withColumn("own", (F.col("n") - 1) * F.col("chars")), "trie-chains")
    below = chain.groupBy("c", F.col("top").alias("depth")).agg(F.lit(1).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.sum("own").alias("saving"))
    rolled = _up(levels, materialise(below, "trie-below"))
    last = F.col("depth") == F.col("len")
    chained = chain.where("n = 1").withColumn("saved", F.lit(0).cast("long")).unionByName(_suffix_sums(chain.where("n > 1")).drop("block", "later"))
    chained = chained.select(
        *(F.col("c").alias("node"), "depth", F.col("c").alias("parent"), F.col("n").alias("n_convs"), F.when(last, F.col("c")).alias("ends")),
        *(F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved"),
    )
    nodes = _union([*rolled, chained])
    ended = nodes.where("ends IS NOT NULL").join(_ends(classes, several), F.col("ends") == F.col("c"))
    ended = ended.select(*nodes.columns, "sha").unionByName(nodes.where("ends IS NULL").withColumn("sha", F.lit(_NOTHING)))
    own = {"node": "conv_id", "parent": "parent_conv_id", "saved": "saved_tokens", "sha": "ends_sha256"}
    return ended.withColumnsRenamed(own).select(*names)


ORACLE = rf"""
WITH k AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, coalesce(role, '') || chr(0) || coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, md5(said) AS key, length(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, left(said, {TIE}), md5(said)) AS pos FROM o),
h AS (SELECT c, c - c % 100 AS base, count(*) AS total, CASE WHEN c % 100 = 0 THEN 0 ELSE xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'),
  lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, any_value(t)[(xor(a, b) & 255) + 1])), 4294967295) % 6 END AS h FROM p, k GROUP BY c),
g AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.total, 0)) AS m, least(h.h, coalesce(b.total, 0)) + greatest(h.total - h.h, 0) AS len FROM h LEFT JOIN h AS b ON h.base = b.c),
r AS (SELECT g.c, pos - g.h + g.m AS depth, key, chars FROM p JOIN g USING (c) WHERE pos > g.h UNION ALL SELECT g.c, pos, key, chars FROM g JOIN p ON p.c = g.base WHERE pos <= g.m),
x AS (SELECT c, depth, chars, md5(string_agg(key, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM r UNION ALL SELECT c, 0, 0, 'root' FROM g),
n AS (SELECT node, depth, min(x.c) AS c, count(*) AS n_convs, max(chars) * (count(*) - 1) AS own, coalesce(string_agg(x.c::VARCHAR, ',' ORDER BY x.c) FILTER (depth = len), '') AS ends FROM x JOIN g USING (c) GROUP BY ALL),
u AS (SELECT n.node, q.node AS parent FROM n JOIN x AS q ON q.c = n.c AND q.depth = n.depth - 1),
l AS (SELECT n.*, u.parent, coalesce(v.kids, 0) AS kids FROM n LEFT JOIN u USING (node) LEFT JOIN (SELECT parent AS node, count(*) AS kids FROM u GROUP BY parent) v USING (node)),
s AS (SELECT x.node, sum(l.own) AS saved, count(*) FILTER (l.kids = 0) AS leaves FROM l JOIN x ON x.c = l.c AND x.depth <= l.depth GROUP BY x.node)
SELECT l.c AS conv_id, l.depth, q.c AS parent_conv_id, l.n_convs, l.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM l JOIN s USING (node) LEFT JOIN n AS q ON q.node = l.parent
"""
