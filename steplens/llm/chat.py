"""Chat formatting by grammar round trip. DataFrame functions only.

A formatted conversation is a header line and its turns:

    #chat raw            or  #chat escaped
    ### user: text</turn>
    ### assistant: text</turn>

The parser ends a turn at each close mark and its role at the first colon and space. What it reads from the raw form is
held against the source; only where they differ is the conversation written in the escaped form, in which a backslash
stands before each backslash and inside each control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW, ESCAPED = "#chat raw\n", "#chat escaped\n"
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>"
LEARNED_ROLE = "assistant"
#: Turns that are cut out of a formatted conversation at once.
BLOCK = 256


def escape(x: Column, role: bool = False) -> Column:
    for mark, safe in [("\\", "\\\\"), (CLOSE, "<\\/turn>"), ("###", "\\###")] + [(AFTER_ROLE, ":\\ ")] * role:
        x = F.replace(x, F.lit(mark), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _render(turns: str, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        role, text = (escape(t["role"], role=True), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE + "\n"))

    return F.concat(F.lit(ESCAPED if escaped else RAW), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read from a formatted conversation; what breaks the grammar gives null roles."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    parts = F.split(F.substr(formatted, F.when(escaped, len(ESCAPED) + 1).otherwise(len(RAW) + 1)), CLOSE, -1)

    def one(part: Column, i: Column) -> Column:
        body = F.when(i == 0, part).otherwise(F.substr(part, F.lit(2)))
        at = F.instr(body, AFTER_ROLE)
        fits = F.startswith(body, F.lit(OPEN)) & (at > 0) & ((i == 0) | F.startswith(part, F.lit("\n")))
        role = F.when(fits, F.substr(body, F.lit(len(OPEN) + 1), at - 1 - len(OPEN)))
        text = F.substr(body, at + len(AFTER_ROLE))
        return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): each conversation as one text, and its turns read back from that text.

    Turns stand in the order of turn, then role and text; null roles and texts count as empty, a null turn comes first,
    repeated rows repeat, and rows of null conv_id make one conversation. An empty table gives no rows. A conversation is
    one value of the result, so it must fit one row; rows of other conversations never share its memory.
    """
    filled = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    raw = source.withColumn("raw", _render("source", False)).withColumn("read", parse(F.col("raw")))
    formatted = raw.select("conv_id", "source", F.when(F.col("read") == F.col("source"), F.col("raw")).otherwise(_render("source", True)).alias("formatted"))
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    sound = F.assert_true(F.col("turns") == F.col("source"), F.lit("a formatted conversation does not read back as its source"))
    return read.select("conv_id", "formatted", F.when(sound.isNull(), F.col("turns")).alias("turns"))


def loss_mask(turns: str = "turns", formatted: str = "formatted") -> Column:
    """Run lengths of the loss mask over the UTF-8 bytes of the formatted text, off and on in turn: what is learned is the
    text of each assistant turn as it stands there, without its marks."""
    escaped = F.startswith(F.col(formatted), F.lit(ESCAPED))
    as_written = lambda x, role: F.octet_length(F.when(escaped, escape(x, role)).otherwise(x))

    def runs(t: Column, i: Column) -> Column:
        before = F.when(i == 0, F.when(escaped, len(ESCAPED)).otherwise(len(RAW))).otherwise(len(CLOSE) + 1)
        off = before + len(OPEN) + as_written(t["role"], True) + len(AFTER_ROLE)
        return F.struct(off.alias("marks"), as_written(t["text"], False).alias("text"), (t["role"] == LEARNED_ROLE).alias("learned"))

    return F.transform(turns, runs)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def learned_text(formatted: str = "formatted", mask: str = "mask") -> Column:
    """All text of ``formatted`` under the loss mask, cut out by its runs, unescaped, in order.

    The runs are taken in blocks of ``BLOCK`` turns, each cut out of the whole text once, so that the time grows with the length of the
    conversation and not with its square."""
    escaped = F.startswith(F.col(formatted), F.lit(ESCAPED))

    def cut(text: Column, runs: Column) -> Column:
        def take(done: Column, run: Column) -> Column:
            begin = done["at"] + run["marks"]
            own = F.substring(text, begin + 1, run["text"]).cast("string")
            own = F.when(run["learned"], F.when(escaped, unescape(own)).otherwise(own)).otherwise("")
            return F.struct((begin + run["text"]).alias("at"), F.concat(done["text"], own).alias("text"))

        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), take, lambda done: done["text"])

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(mask) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(mask, i + 1, BLOCK))
    length = lambda runs: F.aggregate(runs, F.lit(0), lambda n, run: n + run["marks"] + run["text"])
    sums = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda ends, runs: F.concat(ends, F.array(F.element_at(ends, -1) + length(runs))))

    def whole(given: Column) -> Column:
        bound = F.struct(given["raw"].alias("raw"), given["blocks"].alias("blocks"), sums(given["blocks"]).alias("ends"))
        return _let(bound, lambda v: F.array_join(F.transform(v["blocks"], lambda runs, i: cut_block(v, runs, i)), ""))

    def cut_block(v: Column, runs: Column, i: Column) -> Column:
        begin = F.get(v["ends"], i)
        return _let(F.substring(v["raw"], begin + 1, F.get(v["ends"], i + 1) - begin), lambda text: cut(text, runs))

    return _let(F.struct(F.col(formatted).cast("binary").alias("raw"), blocks.alias("blocks")), whole)
