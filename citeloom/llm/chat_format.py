"""Chat formatting with typed content parts, all in DataFrame operations.

A turn is a list of parts: text, image, audio or document.  A visitor flattens
them in order: text is escaped, any other part becomes a placeholder that names
its kind and its number in the conversation, with a reference kept beside the
text and a count of the tokens that will take the placeholder's place.

The template: ``<turn ROLE>`` + body + ``</turn>`` + line feed.  In bodies and
roles a backslash becomes ``\\b`` and the ``<`` of any control string ``\\l``, so
that no text can hold a control string, and both are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = "<(/?turn|image|audio|document)"
OPEN, CLOSE = "<turn ", "</turn>\n"
#: What one part other than text expands to: tokens for each unit (an image's tiles, a recording's seconds, a document's pages) and at least.
TOKENS = {"image": (85, 85), "audio": (25, 25), "document": (600, 600)}
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), CONTROL, r"\\l$1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit(">"), F.lit("\\g"))


#: The most tokens that one part can stand for.
MOST_TOKENS = 1 << 53


def expanded_tokens(part: Column) -> Column:
    """How many tokens stand for a part that isn't text: those of its units, rounded up, a missing number counting as one.

    Negative units and those that aren't a number give the least of the kind;
    very many give MOST_TOKENS.
    """
    out = F.lit(0).cast("long")
    for kind, (each, least) in TOKENS.items():
        units = F.coalesce(part["units"], F.lit(1.0)) * each
        bounded = F.when(F.isnan(units), 0.0).otherwise(F.least(F.greatest(units, F.lit(0.0)), F.lit(float(MOST_TOKENS))))
        out = F.when(part["kind"] == kind, F.greatest(F.lit(least).cast("long"), F.ceil(bounded))).otherwise(out)
    return out


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*TOKENS), F.lit(False))


def text_parts(text: Column) -> Column:
    """A turn of text alone; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, n_turns, formatted, spans, loss_mask, attachments from turns (conv_id, turn, role, parts).

    ``spans`` has the place of each turn in ``formatted``, in code points: that
    of the turn (at), of its body (start, length), and whether it counts for the
    loss.  ``loss_mask`` lists (start, length) of those that do: the body of each
    turn of the loss role.  ``attachments`` lists (number, turn, kind, ref,
    tokens) in the order of the placeholders.  Turns go by their number, null
    first; equal numbers by role, then by their content.  A null role is an
    empty one, null parts are none, and a part of another kind counts as text.

    The visitor works on a row for each part; numbers and places are running
    sums over them, so that work is in proportion to the parts of a
    conversation.  A conversation is one value by nature, so its turns meet in
    one task, in one shuffle; a null conv_id is a conversation.  An empty table
    gives no rows; extra columns are ignored.
    """
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts"), F.array().cast(PARTS)).cast(PARTS).alias("parts"))
    of = Window.partitionBy("conv_id")
    before = (Window.unboundedPreceding, -1)
    numbered = one.withColumn("seq", F.row_number().over(of.orderBy("turn", "role", "parts")))
    visited = numbered.select("conv_id", "turn", "role", "seq", F.posexplode_outer("parts").alias("pos", "part"))
    attached = _attached(F.col("part"))
    number = F.coalesce(F.sum(attached.cast("int")).over(of.orderBy("seq", "pos").rowsBetween(*before)), F.lit(0)).cast("int")
    visited = visited.withColumn("number", number)
    shown = F.when(attached, F.concat(F.lit("<"), F.col("part.kind"), F.lit(" "), F.col("number").cast("string"), F.lit(">"))).otherwise(escape(F.coalesce(F.col("part.text"), F.lit(""))))
    note = F.when(attached, F.struct("number", "turn", F.col("part.kind").alias("kind"), F.col("part.ref").alias("ref"), expanded_tokens(F.col("part")).alias("tokens")))
    laid = visited.groupBy("conv_id", "seq").agg(
        F.first("turn").alias("turn"),
        F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), shown.alias("shown")))), lambda x: x["shown"]), "").alias("body"),
        F.array_sort(F.collect_list(note)).alias("notes"),
    )
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(">"))
    laid = laid.withColumns({"head": head, "length": F.char_length("body")}).withColumn("size", F.char_length("head") + F.col("length") + len(CLOSE))
    laid = laid.withColumn("at", F.coalesce(F.sum("size").over(of.orderBy("seq").rowsBetween(*before)), F.lit(0)))
    span = F.struct("at", (F.col("at") + F.char_length("head")).alias("start"), F.col("length").cast("long").alias("length"), (F.col("role") == loss_role).alias("loss"))
    row = F.struct("seq", F.concat("head", "body", F.lit(CLOSE)).alias("shown"), span.alias("span"), "notes")
    chats = laid.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return chats.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["shown"]), "").alias("formatted"),
        F.transform("rows", lambda r: r["span"]).alias("spans"),
        F.transform(F.filter("rows", lambda r: r["span"]["loss"]), lambda r: F.struct(r["span"]["start"].alias("start"), r["span"]["length"].alias("length"))).alias("loss_mask"),
        F.flatten(F.transform("rows", lambda r: r["notes"])).alias("attachments"),
    )


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without the string that begins it; no text holds that."""
    return F.filter(F.split(formatted, F.lit(OPEN)), lambda x, i: i > 0)


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, read back from a formatted conversation; placeholders stay as they are."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ">", 1)
        body = F.substr(piece, F.char_length(role) + 2, F.char_length(piece) - F.char_length(role) - 1 - len(CLOSE))
        return F.struct(unescape(F.replace(role, F.lit("\\g"), F.lit(">"))).alias("role"), unescape(body).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the spans that count for the loss, unescaped; each is read from its turn's own piece, in one pass."""

    def text(piece: Column, span: Column) -> Column:
        first = (span["start"] - span["at"]).cast("int") - len(OPEN) + 1
        return F.when(span["loss"], unescape(F.substr(piece, first, span["length"].cast("int"))))

    return F.array_join(F.zip_with(_pieces(formatted), spans, text), "")  # without those that are null
