"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, and merged where neighbours share a role; the formatted text is built by array
functions. The template:

    <|bos|> then per merged message  <|role|>ROLE<|text|>TEXT[<|turn|>TEXT ...]<|end|>

``<|turn|>`` keeps apart the turns that were merged, so that the text can be read back turn by turn. Inside roles and
texts every control string is made harmless, reversibly: "&" becomes "&amp;" and "<|" becomes "&lt;|"; since nothing
else writes "<|", a control string can only come from the template. Other models' control strings (such as "[INST]" or
"</s>") have no meaning in this template and pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, ROLE, TEXT, TURN, END = "<|bos|>", "<|role|>", "<|text|>", "<|turn|>", "<|end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (array of start and length in code points, 1-based).

    Rows are ordered by turn (null first), equal turn numbers by role, then text. Null text and null role are empty.
    Exactly repeated rows count as turns of their own. Null conversation ids form one conversation. An empty table
    gives an empty result; other columns are ignored. The loss mask covers the texts of assistant turns, one span per
    turn.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # a long conversation is gathered in sorted pieces first
    pieces = turns.groupBy(F.col(conv_col).alias("conv"), F.expr(f"{turn_col} div 512").alias("piece")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    convs = pieces.groupBy("conv").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    # where a message begins: the first turn, and each turn whose role differs from the one before
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    convs = convs.withColumn("starts", starts)
    message = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: escaped(t["text"])).alias("texts"),
        ),
    )
    convs = convs.select("conv", message.alias("messages"))
    # pieces of the output in order; those under the mask carry true
    def rendered(m: Column) -> Column:
        masked = m["role"] == "assistant"
        head = F.array(F.struct(F.concat(F.lit(ROLE), escaped(m["role"]), F.lit(TEXT)).alias("s"), F.lit(False).alias("loss")))
        body = F.transform(m["texts"], lambda t: F.array(F.struct(t.alias("s"), masked.alias("loss")), F.struct(F.lit(TURN).alias("s"), F.lit(False).alias("loss"))))
        body = F.flatten(body)
        tail = F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss")))
        return F.concat(head, F.slice(body, 1, F.size(body) - 1), tail)

    first = F.array(F.struct(F.lit(BOS).alias("s"), F.lit(False).alias("loss")))
    convs = convs.withColumn("out", F.concat(first, F.flatten(F.transform("messages", rendered))))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["s"])).alias("at"),
        F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.char_length(x["s"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("out", zero, step, lambda acc: acc["spans"])
    return convs.select(F.col("conv").alias(conv_col), F.array_join(F.transform("out", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    messages = F.split(F.regexp_replace(formatted, r"^<\|bos\|><\|role\|>", ""), r"<\|role\|>")

    def turns(m: Column) -> Column:
        halves = F.split(F.regexp_replace(m, r"<\|end\|>$", ""), r"<\|text\|>", 2)
        return F.transform(F.split(F.get(halves, F.lit(1)), r"<\|turn\|>"), lambda t: F.struct(unescaped(F.get(halves, F.lit(0))).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"], s["length"]))), "")
