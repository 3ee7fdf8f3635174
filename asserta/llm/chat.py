"""Chat formatting with Spark expressions: a conversation's turns become one text with a loss mask.

Template: ``<|turn|>role\\n``, the texts of adjacent turns of one role with ``<|and|>`` between, ``<|end|>\\n``. Inside
texts and roles every ``<``, backslashes, ``|`` gets one more backslash, so no control string can arise from them and
`read_back` restores them exactly; a line break in a role is written ``<|nl|>``. The loss mask covers the assistant's
texts as they stand in the output, without marks.

A conversation is one row of the output, so its turns have to meet in one task; columns of no use are dropped before
that, and a conversation as long as Spark's longest row (2 GB) is the limit.

Edge cases: turns are put in order by number, then role, then text, nulls first, so ties and repeated rows (each
stays a turn of its own) have one result; null texts and roles are empty ones; a null conversation id is a
conversation. An empty table gives no rows. Columns of other names are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asserta.llm import _expr
from asserta.llm._expr import let, running, stretch

TURN, AND, END, LINE = "<|turn|>", "<|and|>", "<|end|>\n", "<|nl|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as one: (role, texts). Each turn is copied once."""

    def cut(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x["role"] != F.element_at(t, F.greatest(i, F.lit(1)))["role"]), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, k: let(F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda own: F.struct(own[0]["role"].alias("role"), F.transform(own, lambda x: x["text"]).alias("texts")))))

    return let(turns, cut)


def conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id and its merged turns. rows: conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("conv_id", merged(F.col("t")).alias("turns"))


def pieces(turns: Column) -> Column:
    """The output's pieces in order: (text, whether the loss counts it)."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("s"), loss.alias("loss"))

    def turn(x: Column) -> Column:
        no = F.lit(False)
        head = piece(F.concat(F.lit(TURN), F.replace(escape(x["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n")), no)
        body = F.transform(x["texts"], lambda t, i: F.filter(F.array(F.when(i > 0, piece(F.lit(AND), no)), piece(escape(t), x["role"] == ASSISTANT)), lambda y: y.isNotNull()))
        return F.concat(F.array(head), F.flatten(body), F.array(piece(F.lit(END), no)))

    return F.flatten(F.transform(turns, turn))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: (start, length) in code points of each stretch under the loss mask."""
    ends = running(F.transform("p", lambda x: F.length(x["s"]).cast("long")))
    spans = F.zip_with("p", ends, lambda x, e: F.struct((e - F.length(x["s"])).alias("start"), F.length(x["s"]).alias("length"), x["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return conversations(rows).select("conv_id", pieces(F.col("turns")).alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), loss.alias("loss"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted text, each as it was before turns were merged."""

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|and\|>", -1), lambda t: F.struct(unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(t).alias("text")))

    parts = F.split(text, r"<\|turn\|>", -1)
    return F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn))


def under_loss(text: Column, loss: Column) -> Column:
    """What the mask covers, restored and joined."""
    return let(_expr.pieces(text), lambda p: F.array_join(F.transform(loss, lambda x: unescape(stretch(p, x["start"], x["start"] + x["length"]))), ""))


def digests(rows: DataFrame) -> DataFrame:
    """For each conversation, counts and digests of what is read back from its formatted text."""
    made = formatted(rows).withColumn("turns", read_back(F.col("formatted"))).withColumn("under", under_loss(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same results by DuckDB over the table `conversations` and the rows of conversation -1.
SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w = role, false) AS goes_on,
        length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_chars, length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) AS role_chars
    FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
        coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss,
        sum(text_chars + CASE WHEN goes_on THEN 7 ELSE 8 + role_chars + 1 + 8 END) AS formatted_chars
    FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM summed
"""
