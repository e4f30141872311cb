"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged to a block by array
aggregation, and blocks are put together to one text:

    <|turn|>role<|text|>first text<|part|>second text of the same role<|end|>

Control strings inside roles and texts, the template's own and those of other templates, are escaped: a backslash is put
behind their first character, one more if backslashes stand there already. So no text can end its turn, and taking one backslash
away gives every text back. The loss mask is a list of spans, one for each text of a trained role, without any mark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ChatTemplate:
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    part: str = "<|part|>"
    end: str = "<|end|>"
    trained: tuple[str, ...] = ("assistant",)

    #: What follows the first character of a control string.
    angle: str = r"/?s>|\|[A-Za-z0-9_]*\|>"
    square: str = r"/?INST\]"

    @property
    def _tail(self) -> str:
        return rf"(?:<(?=\\*(?:{self.angle}))|\[(?=\\*(?:{self.square})))"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._tail})", "$1\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"({self._tail})\\", "$1")


def format_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``; spans are ``(at, length)`` in code points, from 0.

    Turns are ordered by ``turn`` (NULL first), ties by role, then text; rows that repeat are turns of their own. A null text or
    role counts as empty. Rows with a NULL ``conv_id`` are one conversation. An empty table gives no rows. Columns
    other than ``conv_id, turn, role, text`` are not read.
    """
    t = template
    empty = F.lit("")
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("one"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    # A turn opens a block if its role differs from the one before.
    opens = F.transform(
        "turns",
        lambda x, i: F.struct(
            x.role.alias("role"),
            t.escape(x.text).alias("text"),
            ((i == 0) | (F.get("turns", i - 1).role != x.role)).alias("opens"),
            ((i == F.size("turns") - 1) | (F.get("turns", i + 1).role != x.role)).alias("closes"),
            x.role.isin(*t.trained).alias("trained"),
        ),
    )
    marked = turns.select("conv_id", opens.alias("turns"))
    head = lambda x: F.when(x.opens, F.concat(F.lit(t.turn), t.escape(x.role), F.lit(t.text))).otherwise(F.lit(t.part))
    pieces = F.transform(
        "turns", lambda x: F.struct(head(x).alias("head"), x.text.alias("text"), F.when(x.closes, F.lit(t.end)).otherwise(empty).alias("tail"), x.trained.alias("trained"))
    )
    # Where a piece starts is a running sum over rows: inside nested arrays it would be added up anew for every turn.
    cut = marked.select("conv_id", F.posexplode(pieces).alias("place", "piece"))
    size = F.char_length("piece.head") + F.char_length("piece.text") + F.char_length("piece.tail")
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("size", size.cast("bigint")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    at = F.col("start") + F.char_length("piece.head")
    one = F.struct(
        "place", F.concat("piece.head", "piece.text", "piece.tail").alias("whole"),
        F.when(F.col("piece.trained"), F.struct(at.cast("int").alias("at"), F.char_length("piece.text").alias("length"))).alias("span"),
    )
    again = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))
    spans = F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull())
    return again.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """The turns and trained texts of formatted conversations: ``conv_id, turns array<struct<role, text>>, loss_text``.

    The text is cut at the template's marks, each piece with its place in the text; a span of the mask is read from the piece that starts
    where it does.
    """
    t = template
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split("formatted", quoted(t.end)), lambda b: b != "")
    turned = formatted.select("conv_id", F.posexplode(blocks).alias("block", "content"))
    halves = F.split("content", quoted(t.text))
    cut = turned.select("conv_id", "block", F.substring(halves[0], F.lit(len(t.turn) + 1), F.char_length(halves[0])).alias("role"), F.split(halves[1], quoted(t.part)).alias("texts"))
    parts = cut.select("conv_id", "block", "role", F.size("texts").alias("parts"), F.posexplode("texts").alias("part", "text"))
    head = F.when(F.col("part") == 0, len(t.turn) + F.char_length("role") + len(t.text)).otherwise(len(t.part))
    tail = F.when(F.col("part") == F.col("parts") - 1, len(t.end)).otherwise(0)
    sized = parts.withColumn("head", head.cast("bigint")).withColumn("size", F.col("head") + F.char_length("text") + tail)
    before = Window.partitionBy("conv_id").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(None)
    pieces = sized.select(
        "conv_id", (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("head")).alias("at"), F.lit(0).alias("kind"), "block", "part", "role", "text", nothing.cast("int").alias("length")
    )
    masked = formatted.select("conv_id", F.inline("loss_spans")).select(
        "conv_id", F.col("at").cast("bigint").alias("at"), F.lit(1).alias("kind"), nothing.cast("int").alias("block"), nothing.cast("int").alias("part"),
        nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), "length",
    )
    along = Window.partitionBy("conv_id").orderBy("at", "kind")
    follows = F.when((F.lead("kind").over(along) == 1) & (F.lead("at").over(along) == F.col("at")), F.lead("length").over(along))
    met = pieces.union(masked).withColumn("covered", follows).filter("kind = 0")
    one = F.struct("block", "part", t.unescape(F.col("role")).alias("role"), t.unescape(F.col("text")).alias("text"), t.unescape(F.substring("text", F.lit(1), F.col("covered"))).alias("loss"))
    whole = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))
    return whole.select(
        "conv_id", F.transform("pieces", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("pieces", lambda p: p["loss"]), "").alias("loss_text"),
    )
