"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor flattens each turn's parts (text, image, audio, document) into one string with ordered placeholders,
recording what each placeholder refers to and how many tokens it expands to; turns are then joined by a template."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Written after a character that would start a control string in a text, and after itself.
ESC = "␛"
#: Where a control string starts: this module's own marks and those of other common templates.
_STARTS = r"(\x{241b}|<(?=\||/?s>|/?(?:image|audio|document|bos|eos|pad|unk)\b)|\[(?=/?(?:INST|SYS|TOOL|AVAILABLE|IMG))|<(?=</?SYS>>))"
_STARTED = r"([\x{241b}<\[])\x{241b}"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Puts ESC after each character that starts a control string, so that no control string is left; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _STARTS, "$1" + ESC)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _STARTED, "$1")


def expanded_tokens(part: Column, patch: int = 14, merge: int = 2, audio_rate: float = 25.0, page_tokens: int = 800) -> Column:
    """Tokens a part's placeholder stands for: image patches merged in squares, audio frames, document pages; a text has none.
    Sizes that are null or not positive count as the smallest."""
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / F.lit(patch * merge))
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.04)) * F.lit(audio_rate)))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * F.lit(page_tokens))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def visit_parts(parts: Column) -> Column:
    """array<PART> -> its content: escaped texts, and for the n-th image, audio or document part `<|type:n|>` with n from 0 over
    the array. Parts of another or no type are read as text; null parts and null arrays give nothing. Texts that stand side by side
    are escaped as one, so that no control string forms where they meet."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    mark = lambda p, n: F.concat(F.lit("<|"), p["type"], F.lit(":"), n.cast("string"), F.lit("|>"))
    step = lambda acc, p: F.when(
        _is_media(p),
        F.struct(F.concat(acc["out"], escape(acc["text"]), mark(p, acc["n"])).alias("out"), F.lit("").alias("text"), (acc["n"] + 1).alias("n")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["text"], F.coalesce(p["text"], F.lit(""))).alias("text"), acc["n"].alias("n")))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("text"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], escape(acc["text"])))


def attachments(parts: Column) -> Column:
    """array<PART> -> array of (n, type, ref, tokens) for its image, audio and document parts, n as in the placeholders."""
    media = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull() & _is_media(p))
    return F.transform(media, lambda p, i: F.struct(i.alias("n"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))


def text_part(text: Column) -> Column:
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns(conv_id, turn, role, parts array<PART>) -> one row per conversation:
    conv_id, formatted, turns (array of role, content as written, start and length of the content in code points, loss),
    attachments (array of turn index, n, type, ref, tokens), expanded_tokens.

    Turns are in order of (turn, role, parts); null turns come first, null roles are empty. Rows with a null conv_id make one
    conversation, which like any other is one row: a conversation must fit a task. Rows that are repeated stay, one after the other. An empty table gives no rows; other columns are not read."""
    one = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), visit_parts(F.col("parts")).alias("content"),
            attachments(F.col("parts")).alias("media"),
        ).alias("t"),
    )
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    # a running sum in the turns' order says where each begins; the same partitioning then serves the list
    n = (F.length(head(F.col("t"))) + F.length("t.content") + len(END)).cast("long")
    before = F.sum(n).over(Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    one = one.select("conv_id", F.struct("t", F.coalesce(before, F.lit(0).cast("long")).alias("at")).alias("x"))
    conv = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("ts"))
    written = F.transform("ts", lambda x: F.concat(head(x["t"]), x["t"]["content"], F.lit(END)))
    conv = conv.select("conv_id", "ts", F.concat_ws("", written).alias("formatted"))
    placed = F.transform(
        "ts",
        lambda x: F.struct(
            x["t"]["role"].alias("role"), x["t"]["content"].alias("content"), (x["at"] + F.length(head(x["t"]))).cast("long").alias("start"),
            F.length(x["t"]["content"]).cast("long").alias("length"), x["t"]["role"].isin(*loss_roles).alias("loss"),
        ),
    )
    media = F.flatten(F.transform("ts", lambda x, i: F.transform(x["t"]["media"], lambda m: F.struct(i.alias("turn"), m["n"].alias("n"), m["type"].alias("type"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return conv.select("conv_id", "formatted", placed.alias("turns"), media.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, m: a + m["tokens"])
    )


def parse_formatted(formatted: Column) -> Column:
    """What format_conversations wrote -> array of (role, text), unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x.startswith(TURN))
    cut = F.transform(pieces, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|body\|>", 2))
    return F.transform(cut, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(formatted: Column, turns: Column) -> Column:
    """The text under the loss mask, unescaped and joined without anything between."""
    spans = F.filter(turns, lambda t: t["loss"])
    return F.concat_ws("", F.transform(spans, lambda t: unescape(F.substr(formatted, (t["start"] + 1).cast("int"), t["length"].cast("int")))))
