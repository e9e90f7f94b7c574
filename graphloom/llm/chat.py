r"""Operator 4 [native]: chat formatting in budgeted, turn-aligned windows.

Prefix sums of turn tokens cut a conversation into windows of whole turns; each window becomes one training text that
starts with the conversation's system turn and a limited stretch of earlier turns (repeated context, never under the
loss mask), followed by the window's own turns, whose assistant texts carry the loss once.

Budget: with ``room`` the budget less the system turn, history gets at most ``history`` tokens and half the room, own
turns the rest, the span. Multiples of the span cut the prefix sums; the turn that crosses a cut joins the turns that end
before the next one if all fit in a span, else it is a window of its own. History comes from the window before and
shrinks to what the own turns leave. So system, history and own turns stay within the budget unless the system turn and
one other turn alone exceed it; such a window holds only these two.

Template: ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts, ``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so
on (one backslash more), which is undone by taking one away; in roles, a backslash is written ``\b``, a newline ``\n``.

Tokens are estimated without Python as a quarter of the UTF-8 bytes, plus four a turn. Prefix sums are taken in blocks
of 64 turn numbers and over block totals, so a conversation with very many turns is spread over tasks.

Defined cases: null text or role counts as empty; a null conv_id is one conversation; turns are ordered by turn (null
first), then role, then text, repeated rows are repeated turns; a turn longer than the span is a window of its own; a
system turn of the whole budget or more is repeated all the same; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, PER_TURN, BLOCK = 2048, 256, 4, 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    role = escape(F.replace(role, F.lit("\\"), F.lit("\\b")))
    return F.replace(role, F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("\\n"), F.lit("\n"))
    return F.replace(unescape(role), F.lit("\\b"), F.lit("\\"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, start (token offset of the first own turn), n_context, n_tokens, formatted, loss array<struct<from,length>>.

    ``from`` is the 1-based code point at which a text under the loss begins.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns(
        {
            "block": F.expr(f"turn div {BLOCK}"),
            "tokens": F.expr(f"(octet_length(text) + 3) div 4 + {PER_TURN}"),
        }
    )
    totals = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"))
    ahead = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    totals = totals.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    run = F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = written(
        rows.withColumn("run", run)
        .join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
        .withColumn("stop", F.col("ahead") + F.col("run"))
        .select("conv_id", "role", "text", "tokens", (F.col("stop") - F.col("tokens")).alias("before"), "stop")
    )
    system = (
        rows.filter("role = 'system'")
        .groupBy(F.col("conv_id").alias("sc"))
        .agg(F.min_by(F.struct("before", "role", "text", "tokens"), "before").alias("system"))
    )
    room = F.expr(f"{budget} - IF(s < {budget}, s, 0)")
    cut = rows.join(system.select("sc", F.col("system.tokens").alias("s")), F.col("conv_id").eqNullSafe(F.col("sc")), "left")
    cut = (
        cut.withColumn("s", F.coalesce("s", F.lit(0)))
        .withColumn("span", room - F.least(F.lit(history), F.floor(room / 2)))
        .withColumn("cell", F.expr("(stop - 1) div span"))
        .withColumn("crosses", F.expr("before div span < cell"))
        .withColumn("all", F.sum("tokens").over(Window.partitionBy("conv_id", "cell")))  # at most two spans of turns
        .withColumn("apart", (F.col("all") > F.col("span")) & ~F.col("crosses"))
    )
    own = written(
        cut.groupBy("conv_id", "cell", "apart").agg(
            F.sort_array(F.collect_list(F.struct("before", "role", "text", "tokens"))).alias("own"),
            F.min("before").alias("start"),
            F.max("stop").alias("stop"),
            F.first("s").alias("s"),
        )
    )
    past = own.select(F.col("conv_id").alias("c"), F.col("stop").alias("z"), F.col("own").alias("past"))
    most = F.least(F.lit(history), F.lit(budget) - F.col("s") - (F.col("stop") - F.col("start")))
    joined = (
        own.join(past, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("start") == F.col("z")), "left")
        .join(system, F.col("conv_id").eqNullSafe(F.col("sc")), "left")
        .withColumn("most", most)
        .withColumn("past", F.filter(F.coalesce("past", F.slice("own", 1, 0)), lambda t: t["before"] >= F.col("start") - F.col("most")))
        .withColumn(  # the system turn leads every window that neither holds nor already repeats it
            "past",
            F.when(
                F.col("system").isNotNull()
                & (F.col("system.before") < F.coalesce(F.get("past", F.lit(0))["before"], F.col("start"))),
                F.concat(F.array("system"), "past"),
            ).otherwise(F.col("past")),
        )
    )
    turn = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    pieces = joined.select(
        "conv_id",
        "start",
        F.size("past").alias("n_context"),
        F.transform(F.concat("past", "own"), turn).alias("pieces"),
        F.concat("past", "own").alias("turns"),
        F.aggregate(F.concat("past", "own"), F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )
    lengths = F.transform("pieces", lambda p: F.char_length(p))
    offsets = F.aggregate(
        "lengths",
        F.array(F.lit(0)),
        lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)),
    )
    marks = F.transform(
        F.sequence(F.lit(0), F.size("pieces") - 1),
        lambda k: F.struct(
            k.alias("k"),
            (F.get("offsets", k) + len(START) + F.char_length(escape_role(F.get("turns", k)["role"])) + 2).alias("from"),
            F.char_length(escape(F.get("turns", k)["text"])).alias("length"),
        ),
    )
    return (
        pieces.withColumn("lengths", lengths)
        .withColumn("offsets", offsets)
        .withColumn(
            "loss",
            F.transform(
                F.filter(marks, lambda m: (m["k"] >= F.col("n_context")) & (F.get("turns", m["k"])["role"] == "assistant")),
                lambda m: F.struct(m["from"].alias("from"), m["length"].alias("length")),
            ),
        )
        .select("conv_id", "start", "n_context", "n_tokens", F.array_join("pieces", "").alias("formatted"), "loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation, from formatted texts and masks alone: turns and loss digests."""
    piece = F.split("formatted", r"<\|im_start\|>", -1)
    own = F.slice(piece, F.col("n_context") + 2, F.size(piece))
    restored = F.transform(
        own,
        lambda p: F.concat(
            unescape_role(F.substring_index(p, "\n", 1)),
            F.lit("\n"),
            unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)),
            F.lit("\n"),
        ),
    )
    lost = F.transform("loss", lambda m: unescape(F.substring(F.col("formatted"), m["from"], m["length"])))
    read = windows.select(
        "conv_id",
        "start",
        F.size(own).alias("n"),
        F.array_join(restored, "").alias("turns"),
        F.array_join(lost, "").alias("lost"),
        F.char_length("formatted").alias("chars"),
        "n_tokens",
    )
    gathered = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("start", "turns", "lost"))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("n_tokens").alias("most_tokens"),
    )
    lost = F.array_join("all.lost", "")
    return gathered.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("all.turns", ""), 256).alias("turns_sha256"),
        F.char_length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_windows",
        "n_tokens",
        "most_tokens",
    )


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return read_back(format_windows(turns.unionByName(probe)))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(n)
), p AS (
  SELECT *, strlen(text) // 4 + (strlen(text) % 4 > 0)::INT + 4 AS tokens,
         sum(strlen(text) // 4 + (strlen(text) % 4 > 0)::INT + 4) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS stop,
         length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)) AS chars
  FROM t
), q AS (
  SELECT p.*, stop - tokens AS before, coalesce(y.s, 0) AS s, coalesce(y.sb, 9e18::BIGINT) AS sb, coalesce(y.sc, 0) AS sc,
         2048 - CASE WHEN coalesce(y.s, 0) < 2048 THEN coalesce(y.s, 0) ELSE 0 END AS room
  FROM p LEFT JOIN (SELECT conv_id, arg_min(tokens, stop) AS s, min(stop - tokens) AS sb, arg_min(chars, stop) AS sc
                    FROM p WHERE role = 'system' GROUP BY conv_id) y USING (conv_id)
), r AS (
  SELECT *, room - least(256, room // 2) AS span, (stop - 1) // (room - least(256, room // 2)) AS cell FROM q
), u AS (
  SELECT *, before // span >= cell AND sum(tokens) OVER (PARTITION BY conv_id, cell) > span AS apart FROM r
), w AS (
  SELECT conv_id, cell, apart, min(before) AS start, max(stop) AS stop, any_value(s) AS s, any_value(sb) AS sb, any_value(sc) AS sc,
         sum(tokens) AS own, sum(chars) AS chars
  FROM u GROUP BY conv_id, cell, apart
), h AS (  -- repeated history of each window
  SELECT w.conv_id, w.start, any_value(w.own) AS own, any_value(w.chars) AS chars, any_value(w.s) AS s, any_value(w.sb) AS sb, any_value(w.sc) AS sc,
         coalesce(sum(u.tokens), 0) AS past, coalesce(sum(u.chars), 0) AS past_chars, coalesce(min(u.before), w.start) AS first
  FROM w LEFT JOIN w v ON v.conv_id = w.conv_id AND v.stop = w.start
         LEFT JOIN u ON u.conv_id = v.conv_id AND u.cell = v.cell AND u.apart = v.apart AND u.before >= w.start - least(256, 2048 - w.s - w.own)
  GROUP BY w.conv_id, w.start
), f AS (
  SELECT conv_id, count(*) AS n_windows, sum(own + past + CASE WHEN sb < first THEN s ELSE 0 END) AS n_tokens,
         max(own + past + CASE WHEN sb < first THEN s ELSE 0 END) AS most_tokens,
         sum(chars + past_chars + CASE WHEN sb < first THEN sc ELSE 0 END) AS formatted_chars
  FROM h GROUP BY conv_id
)
SELECT p.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY stop)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY stop) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       any_value(f.formatted_chars)::BIGINT AS formatted_chars, any_value(f.n_windows)::BIGINT AS n_windows,
       any_value(f.n_tokens)::BIGINT AS n_tokens, any_value(f.most_tokens)::BIGINT AS most_tokens
FROM p JOIN f ON f.conv_id = p.conv_id GROUP BY p.conv_id
"""
