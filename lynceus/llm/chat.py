"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones, then render.

A log that stores a conversation after each turn holds many prefixes of one conversation. Every turn gets
two rolling 64-bit hashes of the turns up to it; a conversation whose last hashes are those of an inner turn
of another is a prefix of it and goes by an anti-join, and of equal ones the smallest id stays. DataFrame
functions only. Turns travel once, by conversation and chunk of turns, so that no conversation has to fit in
a task; what follows reads that exchange again and moves hashes and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Turn numbers of one chunk.
CHUNK = 256
START, STOP = "<|im_start|>", "<|im_end|>"
_KEY = ["conv_id", "chunk"]


def chunks(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk and its messages (turn, role, text) in their order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))))
    return rows.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def _before() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def places(parts: DataFrame) -> DataFrame:
    """conv_id, chunk, turns before it, and the conversation's turns and chunks."""
    whole = Window.partitionBy("conv_id")
    sizes = parts.select(*_KEY, F.size("messages").cast("long").alias("n"))
    return sizes.select(*_KEY, F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("earlier"), F.sum("n").over(whole).alias("turns"), F.count("*").over(whole).alias("chunks"))


def prefixes(parts: DataFrame) -> DataFrame:
    """conv_id, position (from 1), turns of the conversation, and h1, h2 of the turns up to the position.

    The hashes are running exclusive ors of hashes of position and message: within a chunk, and of whole
    chunks before it.
    """
    message = F.posexplode("messages").alias("n", "m")
    rows = parts.join(places(parts), _KEY).select(*_KEY, "earlier", "turns", message).withColumn("position", F.col("earlier") + F.col("n") + 1)
    rows = rows.select(*_KEY, "turns", "position", F.xxhash64("position", "m.role", "m.text").alias("e1"), F.xxhash64("m.text", F.lit(1), "m.role", "position").alias("e2"))
    whole = rows.groupBy(*_KEY).agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    whole = whole.select(*_KEY, *[F.coalesce(F.bit_xor(x).over(_before()), F.lit(0)).alias(x) for x in ("x1", "x2")])
    upto = Window.partitionBy(*_KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p1", F.bit_xor("e1").over(upto)).withColumn("p2", F.bit_xor("e2").over(upto)).join(whole, _KEY)
    return rows.select("conv_id", "position", "turns", F.col("p1").bitwiseXOR(F.col("x1")).alias("h1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that no other one continues, from `prefixes`."""
    full = turns.filter("position = turns").groupBy("turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = turns.filter("position < turns").select(F.col("position").alias("turns"), "h1", "h2").distinct()
    return full.join(inner, ["turns", "h1", "h2"], "left_anti").select("conv_id")


def rendered(messages: str = "messages") -> Column:
    """The messages of a chunk as text."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    line = lambda m: F.concat(F.lit(START), safe(m["role"]), F.lit("\n"), safe(m["text"]), F.lit(STOP + "\n"))
    return F.array_join(F.transform(messages, line), "")


def collapse(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, rendered.

    conversations has conv_id, turn, role and text; other columns are not read. Turns are ordered by turn
    (null first), role and text, and only their order counts, not their numbers; repeated rows are turns
    of their own. Null roles and texts are empty; rows without a conv_id belong to no conversation.
    Markers inside roles and texts are escaped. Conversations of one chunk are rendered where they lie; the
    chunks of longer ones are brought together as text.
    """
    parts = chunks(conversations, chunk)
    kept = places(parts).drop("earlier").join(maximal(prefixes(parts)), "conv_id", "left_semi")
    one, more = (parts.join(kept.filter(some), _KEY).select(*_KEY, "turns", rendered().alias("rendered")) for some in ("chunks = 1", "chunks > 1"))
    many = more.groupBy("conv_id").agg(F.max("turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("chunk", "rendered"))).alias("x"))
    many = many.select("conv_id", "n_turns", F.array_join(F.transform("x", lambda s: s["rendered"]), "").alias("rendered"))
    return one.select("conv_id", F.col("turns").alias("n_turns"), "rendered").unionByName(many)
