"""Chat formatting in budgeted, turn-aligned windows with loss spans; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The template: OPEN role MID text CLOSE. A character that could begin a control string is followed by a backslash inside roles and
#: texts, so none occurs in them, be it of this template or another's.
OPEN, MID, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
ESCAPED = r"([<\[\\])"
TURN = r"(?s)<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n"
#: Tokens that the template adds to a turn.
FRAME = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED + r"\\", "$1")


def tokens_of(text: Column) -> Column:
    """An estimate: one token for four characters, and the template's."""
    return F.floor((F.char_length(text) + 3) / 4).cast("long") + FRAME


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192, repeat: int = 2) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv_id, window int, n_repeated int, n_new int, tokens long, text
    string, loss array<struct<start int, length int>> (code points of text, from 0).

    Prefix sums of tokens place the turns on strides of budget less history and system tokens (a quarter of the
    budget at least); turns inside one stride form a window, a turn across a border is a window of its own. So a window keeps to
    the budget unless one turn alone or the system turn exceeds it. Each window starts with the system turn, if the conversation starts
    with one, and up to `repeat` turns before it that fit `history` tokens; repeated turns carry no loss, so each assistant
    text is a target once. Turns go by turn, role and text, null turns first; null roles and texts are empty; repeated rows are turns
    each; an empty table gives no windows; null conv_ids form one conversation; further columns are ignored. Of one conversation
    a task holds the rows but not their rendering.
    """
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    t = turns.select("conv_id", F.col("turn"), role.alias("role"), text.alias("text"))
    t = t.select("*", F.row_number().over(w).alias("n"), tokens_of(F.col("text")).alias("tokens"))
    t = t.withColumn("head", (F.col("n") == 1) & (F.col("role") == "system"))
    t = t.withColumn("system", F.first(F.when(F.col("head"), F.col("tokens")).otherwise(F.lit(0))).over(so_far))
    t = t.withColumn("end", F.sum(F.when(F.col("head"), F.lit(0)).otherwise(F.col("tokens"))).over(so_far))
    t = t.withColumn("before", F.col("end") - F.when(F.col("head"), F.lit(0)).otherwise(F.col("tokens")))
    stride = F.greatest(F.lit(max(1, budget // 4)), F.lit(budget - history) - F.col("system"))
    across = F.floor((F.col("end") - 1) / stride) > F.floor(F.col("before") / stride)
    t = t.withColumn("key", F.when(~F.col("head"), F.floor(F.col("before") / stride) * 2 + across.cast("long")))
    t = t.withColumn("key", F.coalesce("key", F.lead("key").over(w), F.lit(0)))
    t = t.withColumn("first", (F.col("n") == 1) | (F.col("key") != F.lag("key").over(w)))
    own = F.struct(F.col("key"), F.lit(False).alias("again"))
    again = [
        F.when(~F.col("head") & F.lead("first", i).over(w) & (F.lead("before", i).over(w) - F.col("before") <= history), F.struct(F.lead("key", i).over(w).alias("key"), F.lit(True).alias("again")))
        for i in range(1, repeat + 1)
    ]
    start = F.first(F.struct("head", "role", "text", "tokens")).over(so_far)
    t = t.withColumn("lead", F.when(F.col("first") & (F.col("n") > 1), start))
    t = t.withColumn("lead", F.when(F.col("lead.head"), F.col("lead")))
    t = t.withColumn("places", F.array(own, *again))
    t = t.select("conv_id", "n", "role", "text", "tokens", "lead", F.explode(F.array_compact("places")).alias("in"))
    turn = F.struct("n", F.col("in.again").alias("again"), (F.col("role") == "assistant").alias("target"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    g = t.groupBy("conv_id", F.col("in.key").alias("key")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("in.again").cast("int")).cast("int").alias("again"),
        F.first(F.when(~F.col("in.again"), F.col("lead")), ignorenulls=True).alias("lead"),
    )
    lead = F.coalesce(_rendered(escape(F.col("lead.role")), escape(F.col("lead.text"))), F.lit(""))
    body = F.transform("turns", lambda x: _rendered(x["role"], x["text"]))
    frame = len(OPEN) + len(MID) + len(CLOSE)
    spans = F.aggregate(
        "turns",
        F.struct(F.char_length("lead_text").alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + frame + F.char_length(x["role"]) + F.char_length(x["text"])).alias("at"),
            F.when(x["again"] | ~x["target"], acc["spans"])
            .otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(OPEN) + F.char_length(x["role"]) + len(MID)).alias("start"), F.char_length(x["text"]).alias("length")))))
            .alias("spans"),
        ),
    )["spans"]
    g = g.withColumn("lead_text", lead)
    return g.select(
        "conv_id", F.col("key").cast("int").alias("window"),
        (F.col("again") + F.col("lead").isNotNull().cast("int")).alias("n_repeated"), (F.size("turns") - F.col("again")).alias("n_new"),
        (F.col("tokens") + F.coalesce(F.col("lead.tokens"), F.lit(0))).alias("tokens"),
        F.concat(F.col("lead_text"), F.concat_ws("", body)).alias("text"), spans.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns long, turns string (role, newline, text, newline for each turn), loss string, formatted_chars long: what the
    windows' texts and loss spans say, unescaped."""
    roles, texts = (F.slice(F.regexp_extract_all("text", F.lit(TURN), F.lit(i)), F.col("n_repeated") + 1, F.greatest("n_new", F.lit(0))) for i in (1, 2))
    said = F.concat_ws("", F.zip_with(roles, texts, lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))))
    part = windows.select("conv_id", "window", F.size(roles).alias("n"), said.alias("turns"), loss.alias("loss"), F.char_length("text").alias("chars"))
    parts = part.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return parts.select("conv_id", "n_turns", F.concat_ws("", F.transform("parts", lambda p: p["turns"])).alias("turns"), F.concat_ws("", F.transform("parts", lambda p: p["loss"])).alias("loss"), "formatted_chars")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn int, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_windows(turns))
    return back.select("conv_id", "n_turns", common.hex_digest(F.col("turns")).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), common.hex_digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (
  SELECT *, row_number() OVER w AS n, (length(text) + 3) // 4 + 4 AS tokens,
         24 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), b AS (SELECT *, n = 1 AND role = 'system' AS head FROM a),
d AS (
  SELECT *, first_value(CASE WHEN head THEN tokens ELSE 0 END) OVER w AS system, first_value(CASE WHEN head THEN chars ELSE 0 END) OVER w AS system_chars,
         sum(CASE WHEN head THEN 0 ELSE tokens END) OVER w AS e FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY n)
), f AS (SELECT *, e - CASE WHEN head THEN 0 ELSE tokens END AS s, greatest(256, 1024 - 192 - system) AS stride FROM d),
g AS (SELECT *, CASE WHEN NOT head THEN (s // stride) * 2 + CASE WHEN (e - 1) // stride > s // stride THEN 1 ELSE 0 END END AS k0 FROM f),
h AS (SELECT *, coalesce(k0, lead(k0) OVER (PARTITION BY conv_id ORDER BY n), 0) AS k FROM g),
i AS (SELECT *, n = 1 OR k <> lag(k) OVER (PARTITION BY conv_id ORDER BY n) AS fresh FROM h),
j AS (
  SELECT *, chars
    + CASE WHEN NOT head AND lead(fresh, 1) OVER w AND lead(s, 1) OVER w - s <= 192 THEN chars ELSE 0 END
    + CASE WHEN NOT head AND lead(fresh, 2) OVER w AND lead(s, 2) OVER w - s <= 192 THEN chars ELSE 0 END
    + CASE WHEN fresh AND n > 1 THEN system_chars ELSE 0 END AS total
  FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY n)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(total) AS BIGINT) AS formatted_chars
FROM j GROUP BY conv_id
"""
