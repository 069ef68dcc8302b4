"""Chat formatting into windows of a token budget, with DataFrame functions only.

Template: a turn is ``<s>[role]text</s>``, a repeated turn ``<h>[role]text</h>``.
In roles and texts ``~ < [ ]`` become ``~0 ~1 ~2 ~3``, so that no control string
of this or another template survives inside them; reading back undoes it.

Prefix sums of the turns' tokens choose the windows: room for new turns is the
budget less the system turn and the history; turns that lie inside one stretch
of that many tokens share a window, and a turn across the border of two
stretches has a window of its own.  The system turn is the first turn with that
role, wherever it stands; each later window repeats it.  A window also repeats
the turns that begin within `history` tokens before its first new one.  Where the
system turn, the new turns and the history are above the budget, the history
gives way, its oldest turns first; the system turn never does.  So a window is
above the budget only if it has one new turn that is above it together with the
system turn.  Repeated turns are masked: each assistant text is under the loss
mask in exactly one window.

Tokens are estimated as words (runs without white space) and MARKS for a turn; a
column with a text's own count can stand in for the words.

Edge cases: null roles and texts are empty; turns are ordered by turn, then
role, then text, null first; rows that are repeated are turns each; a null
conv_id is one conversation; an empty table has no windows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a turn's marks.
MARKS = 4


def escape(text: F.Column) -> F.Column:
    for plain, code in (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: F.Column) -> F.Column:
    for plain, code in (("]", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_windows(conversations: DataFrame, budget: int = 512, history: int = 128, tokens: F.Column | None = None) -> DataFrame:
    """conv_id, window (ascending, from 0), n_new (turns), n_tokens, formatted and loss (code point spans, end exclusive).

    tokens: a column of `conversations` with the tokens of each text, e.g. joined from a table of a tokenizer's counts.
    """
    conv = Window.partitionBy("conv_id")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.lit(None) if tokens is None else tokens).cast("long").alias("counted"))
    words = F.coalesce("counted", F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")) + MARKS
    in_order = conv.orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = rows.withColumn("tokens", words).withColumn("nth", F.row_number().over(in_order)).withColumn("upto", F.sum("tokens").over(so_far))
    turns = turns.withColumn("before", F.col("upto") - F.col("tokens")).withColumn("body", F.concat(F.lit("["), escape(F.col("role")), F.lit("]"))).withColumn("inner", escape(F.col("text")))
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    system = F.first(F.when(F.col("role") == "system", F.struct("nth", F.concat(F.lit("<h>"), "body", "inner", F.lit("</h>")).alias("piece"), F.col("tokens"))), ignorenulls=True).over(whole)
    turns = turns.withColumn("system", system)
    is_system = F.coalesce(F.col("nth") == F.col("system.nth"), F.lit(False))
    room = F.greatest(F.lit(1), budget - history - F.coalesce(F.col("system.tokens"), F.lit(0)))
    first, last = F.floor(F.col("before") / room), F.floor((F.col("upto") - 1) / room)
    turns = turns.withColumn("slot", F.when(first == last, 2 * first).otherwise(2 * first + 1))
    slot = Window.partitionBy("conv_id", "slot")
    in_slot = slot.orderBy("nth")
    repeat = F.when(~is_system, F.struct("nth", F.concat(F.lit("<h>"), "body", "inner", F.lit("</h>")).alias("piece"), F.col("tokens"), F.col("before")))
    recent = F.collect_list(repeat).over(conv.orderBy("before").rangeBetween(-history, -1))
    turns = turns.withColumn("place", F.row_number().over(in_slot)).withColumn("fresh", F.sum("tokens").over(slot))
    late = F.coalesce(F.col("nth") > F.col("system.nth"), F.lit(False))
    led = F.when(late, F.col("system.tokens")).otherwise(F.lit(0))
    allowed = F.least(F.lit(history), F.greatest(F.lit(0), budget - F.col("fresh") - led))
    turns = turns.withColumn("recent", F.when(F.col("place") == 1, F.array_sort(F.filter(recent, lambda x: x["before"] >= F.col("before") - allowed))))
    lead = F.concat(F.when(late, F.col("system.piece")).otherwise(F.lit("")), F.array_join(F.transform("recent", lambda x: x["piece"]), ""))
    lead_tokens = led + F.aggregate("recent", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    turns = turns.withColumn("piece", F.concat(F.when(F.col("place") == 1, lead).otherwise(F.lit("")), F.lit("<s>"), "body", "inner", F.lit("</s>")))
    turns = turns.withColumn("cost", F.col("tokens") + F.when(F.col("place") == 1, lead_tokens).otherwise(F.lit(0)))
    turns = turns.withColumn("end", F.sum(F.length("piece")).over(in_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 4)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("nth"), (F.col("end") - F.length("inner")).alias("start"), F.col("end").alias("end")))
    windows = turns.groupBy("conv_id", "slot").agg(F.count(F.lit(1)).alias("n_new"), F.sum("cost").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("spans"))
    joined = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    loss = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return windows.select("conv_id", F.col("slot").cast("long").alias("window"), "n_new", "n_tokens", joined.alias("formatted"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), losses (texts under the mask, in order) and formatted_chars, from the formatted text alone."""
    pieces = F.filter(F.split("formatted", "(?<=</[sh]>)"), lambda p: F.startswith(p, F.lit("<s>")))
    body = lambda p: F.substring(p, 5, F.length(p) - 8)  # noqa: E731  without <s>[ and </s>
    cut = lambda b: F.struct(unescape(F.substring_index(b, "]", 1)).alias("role"), unescape(F.substring(b, F.length(F.substring_index(b, "]", 1)) + 2, F.length(b))).alias("text"))
    turns = F.transform(F.transform(pieces, body), cut)
    losses = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    read = windows.select("conv_id", "window", turns.alias("turns"), losses.alias("losses"), F.length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "losses"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["losses"])).alias("losses"), "formatted_chars")
