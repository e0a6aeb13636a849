"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with `>` are quotes; as many marks, as deep. Consecutive quoted
lines of one depth are a passage. A passage is normalised to its lower-cased words,
hashed, and joined within its conversation to the messages whose own text (without
quotes) has the same words in a row, also where a client wrapped it anew or quoted
a part of a line, however short. One without any letter or digit must equal a
line, a sentence or a paragraph there. Of a passage that no message has, each
line is looked for in the same way.

What links, links to the earliest message that has it. A message replies to the
one that its quotes point to: what only one message says counts before what
several say, then the shallowest quotes, then those with most characters, so a
common line decides only where nothing else links. Messages that a chain of
replies connects form a thread; a conversation is ordered by threads' first
messages, then by turn, so that a reply comes after what it answers, and quotes
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ranked

#: Quote marks at the start of a line.
MARKS = r"^(?:[ \t]*>)+"
#: A line that announces a quote.
ANNOUNCES = r"^On .*wrote:[ \t\r]*$"
#: Words by whose hash a passage is looked for within a message; a shorter one by that of all its words.
ANCHOR = 3


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal(text: Column) -> Column:
    """Lower-cased words of letters and digits with single spaces; of text without any, the text itself."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(norm != "", norm).otherwise(_plain(text))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, key, run, depth, text, lines) of consecutive lines of one depth, as blank lines part them.

    lines and text, which joins them, are without marks; key tells rows of one turn apart.
    """
    rows = messages.select("conv_id", "turn", "text", F.xxhash64("text").alias("key")).dropDuplicates(["conv_id", "turn", "key"])
    each = rows.select("conv_id", "turn", "key", F.posexplode(F.split("text", "\n", -1)).alias("nr", "line"))
    bare = _plain(F.regexp_replace("line", MARKS, ""))
    marks = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))
    each = each.select("conv_id", "turn", "key", "nr", bare.alias("bare"), F.when(bare == "", -1).otherwise(marks).alias("depth"))
    order = Window.partitionBy("conv_id", "turn", "key").orderBy("nr")
    each = each.withColumn("begins", (F.col("depth") != F.coalesce(F.lag("depth").over(order), F.lit(-2))).cast("long"))
    each = each.withColumn("run", F.sum("begins").over(order)).where("depth >= 0")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nr", "bare"))), lambda x: x["bare"])
    runs = each.groupBy("conv_id", "turn", "key", "run", "depth").agg(listed.alias("lines"))
    return runs.withColumn("text", F.array_join("lines", " "))


def quoted_units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, key, run, depth, single, norm) of quoted passages and, if they have several, of their lines."""
    quoted = passages(messages.where(F.col("text").rlike("(?m)" + MARKS))).where("depth > 0")
    both = F.concat(F.array(F.struct(F.lit(False).alias("single"), F.col("text").alias("text"))), F.when(F.size("lines") > 1, F.transform("lines", lambda x: F.struct(F.lit(True).alias("single"), x.alias("text")))).otherwise(F.array()))
    units = quoted.select("conv_id", "turn", "key", "run", "depth", F.explode(both).alias("unit"))
    return units.select("conv_id", "turn", "key", "run", "depth", "unit.single", normal(F.col("unit.text")).alias("norm")).distinct()


def origins(messages: DataFrame, units: DataFrame) -> DataFrame:
    """(conv_id, hash, origin, alone): the first message that has a unit of `units` as its own text, and whether no other has."""
    words = F.split("norm", " ")
    first = F.least(F.size(words), F.lit(ANCHOR))
    anchor = F.when(F.col("norm").rlike(r"[\p{L}\p{N}]"), F.xxhash64(F.array_join(F.slice(words, F.lit(1), first), " ")))
    wanted = units.select("conv_id", F.xxhash64("norm").alias("hash"), F.size(words).alias("n"), first.alias("first"), anchor.alias("anchor")).distinct()
    wanted = materialise(wanted, "quote-wanted")
    told = messages.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    # Units without letters: what they must equal.
    own = passages(told).where("depth = 0").select("conv_id", "turn", "text", "lines")
    parts = F.concat(F.array("text"), F.col("lines"), F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n"))
    equal = own.select("conv_id", "turn", F.explode(parts).alias("text")).select("conv_id", "turn", F.xxhash64(normal(F.col("text"))).alias("hash"))
    equal = equal.join(wanted.where("anchor IS NULL").select("conv_id", "hash"), ["conv_id", "hash"], "left_semi")
    # Others: stretches of words that begin as a unit does, as long as it is. A conversation is asked for so many first words as its units have.
    sizes = wanted.where("anchor IS NOT NULL").groupBy("conv_id").agg(F.collect_set("first").alias("sizes"))
    body = told.select("conv_id", "turn", F.xxhash64("text").alias("key"), F.split(normal(without_quotes(F.col("text"))), " ").alias("words")).dropDuplicates(["conv_id", "turn", "key"])
    at = lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.array_join(F.slice("words", i, k), " ")).alias("anchor")))
    begins = F.explode(F.flatten(F.transform(F.filter("sizes", lambda k: k <= F.size("words")), at))).alias("begin")
    asked = wanted.where("anchor IS NOT NULL").select("conv_id", "anchor", "n").distinct()
    hits = body.join(sizes, "conv_id").select("conv_id", "turn", "key", begins).select("conv_id", "turn", "key", "begin.*").join(asked, ["conv_id", "anchor"])
    hits = hits.groupBy("conv_id", "turn", "key").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    found = F.transform(F.filter("hits", lambda h: h["at"] + h["n"] <= F.size("words")), lambda h: F.xxhash64(F.array_join(F.slice("words", h["at"] + 1, h["n"]), " ")))
    stretches = body.join(hits, ["conv_id", "turn", "key"]).select("conv_id", "turn", F.explode(found).alias("hash"))
    stretches = stretches.join(wanted.where("anchor IS NOT NULL").select("conv_id", "hash"), ["conv_id", "hash"], "left_semi")
    # One row for each conversation and unit, summed before the shuffle: no hot line or conversation.
    return equal.unionByName(stretches.select(equal.columns)).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"), (F.min("turn") == F.max("turn")).alias("alone"))


def without_quotes(text: Column) -> Column:
    """A text without quoted lines and without lines that announce one, trimmed."""
    each = F.split(text, "\n", -1)
    kept = F.filter(each, lambda x, i: ~x.rlike(MARKS) & ~(x.rlike(ANNOUNCES) & F.coalesce(F.get(each, i + 1).rlike(MARKS), F.lit(False))))
    return F.trim(F.array_join(kept, "\n"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): for each message with a linked quote, what it replies to."""
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    units = materialise(quoted_units(messages), "quote-units").withColumn("hash", F.xxhash64("norm"))
    found = units.join(origins(messages, units), ["conv_id", "hash"]).where("origin < turn")
    found = materialise(found.select(*units.columns, "origin", "alone"), "quote-found")
    run = ["conv_id", "turn", "key", "run"]
    whole = found.where(~F.col("single"))
    linked = whole.unionByName(found.where("single").join(whole.select(run), run, "left_anti"))
    linked = linked.groupBy("conv_id", "turn", "hash").agg(F.min("depth").alias("depth"), F.max(F.length("norm")).alias("size"), F.first("origin").alias("origin"), F.first("alone").alias("alone"))
    by_origin = linked.groupBy("conv_id", "turn", "origin").agg(F.max("alone").alias("alone"), F.min("depth").alias("depth"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    best = F.max_by("origin", F.struct("alone", -F.col("depth"), "size", "origin"))
    return by_origin.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), F.sum("n").alias("n_linked"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, reply_depth) for linked messages, by pointer doubling."""
    up = materialise(linked.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).alias("reply_depth")), "quote-up")
    while True:
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread_turn").alias("next"), F.col("reply_depth").alias("more"))
        met = up.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread_turn") == F.col("t")), "left")
        moved = materialise(met.select("conv_id", "turn", F.coalesce("next", "thread_turn").alias("thread_turn"), (F.col("reply_depth") + F.coalesce("more", F.lit(0))).alias("reply_depth"), F.col("t").isNotNull().alias("moved")), "quote-up")
        up = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return up


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotes, a row for each message.

    Returns conv_id, turn, role, body (the text without quotes), parent_turn (what
    it replies to, null if no quote links), thread_turn (the first message of its
    thread), reply_depth, n_quoted (quoted lines), n_linked (different passages, or
    lines of passages that don't link whole, that were found) and position (from 1
    within the conversation, in order of thread, turn, role and body). Of origins
    that tie in all else, the latest is taken. A null text counts as empty. Messages with a null
    conv_id or turn link to nothing; those without a conv_id form one
    conversation, and a null turn comes last. Rows with one conv_id and turn are
    one message for linking, and each gets its row; equal rows take positions of
    their own. Very long texts are read whole. Other columns, whatever their names,
    are ignored. An empty table gives no rows.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = materialise(links(rows), "quote-links")
    chain = linked.join(threads(linked), ["conv_id", "turn"])
    body = rows.select("conv_id", "turn", "role", without_quotes(F.col("text")).alias("body"), F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(MARKS))).cast("long").alias("n_quoted"))
    every = body.join(chain, ["conv_id", "turn"], "left").withColumns({"thread_turn": F.coalesce("thread_turn", "turn"), "reply_depth": F.coalesce("reply_depth", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0))})
    order = ranked(every, ["conv_id", "thread_turn", "turn", "role", "body"], "nr", "quote-order")
    start = materialise(order.groupBy("conv_id").agg((F.min("nr") - 1).alias("start")), "quote-start")
    out = order.alias("o").join(start.alias("s"), F.expr("o.conv_id <=> s.conv_id"))
    return out.select("o.conv_id", "turn", "role", "body", "parent_turn", "thread_turn", F.col("reply_depth").cast("long").alias("reply_depth"), "n_quoted", "n_linked", (F.col("nr") - F.col("start")).alias("position"))


ORACLE = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
b AS (SELECT conv_id, turn, role, text, trim(array_to_string(list_filter(ls, lambda x, i: NOT regexp_matches(x, '{MARKS}')
    AND NOT (regexp_matches(x, '{ANNOUNCES}') AND coalesce(regexp_matches(ls[i + 1], '{MARKS}'), false))), chr(10)), ' ') AS body,
  len(list_filter(ls, lambda x: regexp_matches(x, '{MARKS}')))::BIGINT AS n_quoted FROM m),
l AS (SELECT conv_id, turn, text, generate_subscripts(ls, 1) AS nr, unnest(ls) AS line FROM (SELECT DISTINCT conv_id, turn, text, ls FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
d AS (SELECT conv_id, turn, text, nr, trim(regexp_replace(regexp_replace(line, '{MARKS}', ''), '\s+', ' ', 'g'), ' ') AS bare,
  CASE WHEN bare = '' THEN -1 ELSE length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) END AS depth FROM l),
g AS (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY conv_id, turn, text ORDER BY nr) THEN 1 ELSE 0 END AS begins FROM d),
h AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id, turn, text ORDER BY nr) AS run FROM g),
p AS (SELECT conv_id, turn, text, run, depth, string_agg(bare, ' ' ORDER BY nr) AS whole, list(bare) AS lines FROM h WHERE depth >= 0 GROUP BY ALL),
x AS (SELECT conv_id, turn, text, run, depth, false AS single, whole AS unit FROM p WHERE depth > 0
  UNION SELECT conv_id, turn, text, run, depth, true, unnest(lines) FROM p WHERE depth > 0 AND len(lines) > 1
  UNION ALL SELECT conv_id, turn, text, run, 0, true, unnest(list_concat([whole], lines, string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)))) FROM p WHERE depth = 0
  UNION ALL SELECT conv_id, turn, text, -1, -1, true, body FROM b WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
y AS (SELECT *, trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') AS words,
  CASE WHEN words <> '' THEN words ELSE trim(regexp_replace(unit, '\s+', ' ', 'g'), ' ') END AS norm FROM x),
w AS (SELECT DISTINCT conv_id, norm, words <> '' AS wide FROM y WHERE depth > 0),
f AS (SELECT w.conv_id, w.norm, min(y.turn) AS origin, min(y.turn) = max(y.turn) AS alone FROM w JOIN y ON w.conv_id = y.conv_id
  AND CASE WHEN wide THEN y.depth = -1 AND contains(' ' || y.norm || ' ', ' ' || w.norm || ' ') ELSE y.depth = 0 AND y.norm = w.norm END GROUP BY ALL),
q AS (SELECT y.*, origin, alone FROM y JOIN f USING (conv_id, norm) WHERE depth > 0 AND origin < turn),
k AS (SELECT conv_id, turn, norm, min(depth) AS depth, any_value(origin) AS origin, any_value(alone) AS alone FROM q
  WHERE NOT single OR NOT EXISTS (SELECT 1 FROM q z WHERE NOT z.single AND z.conv_id = q.conv_id AND z.turn = q.turn AND z.text = q.text AND z.run = q.run) GROUP BY ALL),
o AS (SELECT conv_id, turn, origin, max(alone::INT) AS alone, min(depth) AS depth, sum(length(norm)) AS size, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT conv_id, turn, first(origin ORDER BY alone DESC, depth, size DESC, origin DESC) AS parent_turn, sum(n)::BIGINT AS n_linked FROM o GROUP BY ALL),
t AS (SELECT conv_id, turn, parent_turn AS thread_turn, 1::BIGINT AS reply_depth FROM r
  UNION ALL SELECT t.conv_id, t.turn, r.parent_turn, t.reply_depth + 1 FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.thread_turn),
s AS (SELECT conv_id, turn, min(thread_turn) AS thread_turn, max(reply_depth) AS reply_depth FROM t GROUP BY ALL)
SELECT b.conv_id, b.turn, b.role, b.body, b.n_quoted, r.parent_turn, coalesce(s.thread_turn, b.turn) AS thread_turn, coalesce(s.reply_depth, 0) AS reply_depth, coalesce(r.n_linked, 0) AS n_linked,
  row_number() OVER (PARTITION BY b.conv_id ORDER BY coalesce(s.thread_turn, b.turn), b.turn, b.role, b.body) AS position
FROM b LEFT JOIN r USING (conv_id, turn) LEFT JOIN s USING (conv_id, turn)
"""
