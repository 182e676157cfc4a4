"""Chat formatting: quotation linking over DataFrame expressions.

Lines that begin with one or more > are quoted, by as many levels. A passage is a maximal run of lines of one level. Passages and
what their author wrote (a message's whole own text, its paragraphs and its lines) are normalised, lower case with white space as
single spaces, and hashed by SHA-256; a passage is linked to the latest earlier message of its conversation that has its hash. A
message replies to what its first passage of level 1 links to. Following links up gives the thread's first message; ordered by
(thread_turn, turn), each message of a conversation stands after what it replies to. The text loses its quotes and a line
that only introduces one (it ends in a colon, straight before it).

The latest earlier message is found in blocks of turns, so that one very common line or one very long conversation makes no
task hold all its rows.

Nulls: a null text is an empty text; a null turn orders before all others and links with nothing; a null conv_id is no conversation, so
nothing links in it. Repeated (conv_id, turn) rows stay, each linked alike; a link names a turn. Other columns pass unread, unless
they bear the names of added ones, which replace them. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .quality import let

MARK = r"^(?: {0,3}>)+ ?"
BLOCK = 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \x09-\x0D]+", " "))


def hashed(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def parsed(text: Column) -> Column:
    """struct(own: the text without quotes, passages: array<struct(level, text)>)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: let(F.regexp_extract(x, MARK, 0), lambda m: F.struct(F.regexp_count(m, F.lit(">")).cast("int").alias("level"), F.substring(x, F.length(m) + 1, F.length(x)).alias("text"))))

    def of(ls: Column) -> Column:
        n = F.size(ls)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, F.lit(True)).otherwise(F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]))
        runs = let(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(ls, i)["level"].alias("level"), F.array_join(F.transform(F.slice(ls, i + 1, F.coalesce(F.get(h, k + 1), n) - i), lambda x: x["text"]), "\n").alias("text"))))
        introduces = lambda x, i: (x["level"] == 0) & x["text"].rlike(r":[ \x09\x0D]*$") & (F.coalesce(F.get(ls, i + 1)["level"], F.lit(0)) > 0)
        own = F.transform(F.filter(ls, lambda x, i: (x["level"] == 0) & ~introduces(x, i)), lambda x: x["text"])
        passages = F.filter(runs, lambda r: (r["level"] > 0) & (normalised(r["text"]) != ""))
        quoted = F.exists(ls, lambda x: x["level"] > 0)
        whole = F.array_join(F.transform(ls, lambda x: x["text"]), "\n")
        return F.when(quoted, F.struct(F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "").alias("own"), passages.alias("passages"))).otherwise(F.struct(whole.alias("own"), F.array().cast("array<struct<level:int,text:string>>").alias("passages")))

    return let(lines, of)


def with_latest(asks: DataFrame, has: DataFrame) -> DataFrame:
    """asks(conv_id, turn, hash) with from_turn: the largest turn below its own in has(conv_id, turn, hash)."""
    key = ["conv_id", "hash"]
    block = F.floor(F.col("turn") / BLOCK)
    has = has.distinct().withColumn("block", block)
    # In the ask's own block; then the last turn of the latest block before it.
    rows = asks.withColumn("block", block).withColumn("has", F.lit(None).cast("long")).unionByName(has.select(*key, "turn", "block", F.col("turn").alias("has")), allowMissingColumns=True)
    here = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.max("has").over(here)).where("has is null").drop("has")
    ends = has.groupBy(*key, "block").agg(F.max("turn").alias("last"))
    marks = asks.select(*key, block.alias("block")).distinct().withColumn("last", F.lit(None).cast("long")).withColumn("asked", F.lit(True)).unionByName(ends.withColumn("asked", F.lit(False)))
    before = Window.partitionBy(*key).orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    earlier = marks.withColumn("far", F.max("last").over(before)).where("asked").select(*key, "block", "far").distinct()
    return found.join(earlier, [*key, "block"], "left").withColumn("from_turn", F.coalesce("near", "far")).drop("near", "far", "block")


def linked(messages: DataFrame, rounds: int = 64) -> DataFrame:
    """messages(conv_id, turn, role, text) with text freed of quotes, n_quotes, n_linked, reply_to, thread_turn and depth."""
    spark = messages.sparkSession
    rows = messages.withColumn("_p", parsed(F.col("text")))
    base = rows.withColumn("text", F.col("_p.own")).withColumn("n_quotes", F.size("_p.passages").cast("long"))
    quotes = rows.select("conv_id", "turn", F.posexplode("_p.passages").alias("at", "q")).select("conv_id", "turn", "at", F.col("q.level").alias("level"), hashed(F.col("q.text")).alias("hash")).where("conv_id is not null and turn is not null")
    asked = quotes.select("conv_id", "hash").distinct()
    own = F.col("_p.own")
    parts = F.array_distinct(F.transform(F.filter(F.concat(F.array(own), F.split(own, "\n{2,}"), F.split(own, "\n")), lambda x: normalised(x) != ""), hashed))
    # Only what some message quotes goes on.
    has = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(parts).alias("hash")).join(asked, ["conv_id", "hash"], "left_semi")
    found = K.saved(with_latest(quotes, has), spark, "quote-links")
    first = F.min(F.when((F.col("level") == 1) & F.col("from_turn").isNotNull(), F.struct("at", "from_turn")))["from_turn"]
    replies = found.groupBy("conv_id", "turn").agg(F.count("from_turn").alias("n_linked"), first.alias("reply_to"))
    # Each message points to an ancestor; pointers double until all point to a thread's first message.
    up = K.saved(replies.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("to"), F.lit(1).cast("long").alias("depth")), spark, "replies")
    for _ in range(rounds):
        further = up.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        joined = up.join(further, ["conv_id", "to"], "left")
        if joined.where("next is not null").isEmpty():
            break
        up = K.saved(joined.select("conv_id", "turn", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), spark, "replies")
    out = base.drop("_p", "n_linked", "reply_to", "thread_turn", "depth").join(replies, ["conv_id", "turn"], "left").join(up.select("conv_id", "turn", "to", "depth"), ["conv_id", "turn"], "left")
    return out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "thread_turn": F.coalesce("to", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")}).drop("to")


def op1_quote_threads(spark, sf_dir):
    """Every message of `conversations` without its quotes, with its place in the reply order."""
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (SELECT conv_id, turn, i, x, length(regexp_replace(regexp_extract(x, '^(?: {0,3}>)+ ?'), '[^>]', '', 'g')) AS level, substr(x, length(regexp_extract(x, '^(?: {0,3}>)+ ?')) + 1) AS body
 FROM (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS g, lead(level, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM l),
o AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (regexp_matches(body, ':[ \x09\x0D]*$') AND next > 0)), ''), '^\n+|\n+$', '', 'g') AS own, max(level) > 0 AS quoted FROM g GROUP BY conv_id, turn),
w AS (SELECT m.conv_id, m.turn, role, CASE WHEN quoted THEN own ELSE t END AS own FROM m JOIN o ON o.conv_id = m.conv_id AND o.turn = m.turn),
q AS (SELECT conv_id, turn, level, min(i) AS pos, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY i)), '[ \x09-\x0D]+', ' ', 'g')) AS h FROM g WHERE level > 0 GROUP BY conv_id, turn, level, g HAVING h != ''),
p AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(x), '[ \x09-\x0D]+', ' ', 'g')) AS h FROM (SELECT conv_id, turn, unnest(list_concat([own], string_split_regex(own, '\n{2,}'), string_split(own, chr(10)))) AS x FROM w)),
k AS (SELECT q.conv_id, q.turn, q.level, q.pos, max(p.turn) AS f FROM q LEFT JOIN p ON p.conv_id = q.conv_id AND p.h = q.h AND p.turn < q.turn GROUP BY ALL),
r AS (SELECT conv_id, turn, count(f)::BIGINT AS n_linked, arg_min(f, pos) FILTER (WHERE level = 1 AND f IS NOT NULL) AS reply_to FROM k GROUP BY conv_id, turn),
u AS (SELECT conv_id, turn, turn AS top, 0::BIGINT AS depth FROM m UNION ALL SELECT u.conv_id, u.turn, r.reply_to, u.depth + 1 FROM u JOIN r ON r.conv_id = u.conv_id AND r.turn = u.top WHERE r.reply_to IS NOT NULL),
d AS (SELECT conv_id, turn, arg_max(top, depth) AS thread_turn, max(depth)::BIGINT AS depth FROM u GROUP BY conv_id, turn),
c AS (SELECT conv_id, turn, count(*)::BIGINT AS n_quotes FROM q GROUP BY conv_id, turn)
SELECT w.conv_id, w.turn, role, own AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to, thread_turn, depth
FROM w JOIN d ON d.conv_id = w.conv_id AND d.turn = w.turn LEFT JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn LEFT JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn
"""
