"""Chat formatting with typed content parts (DataFrame functions only).

A turn is a role and an array of parts ``struct<type, text, ref, n_tokens>``. The visitor flattens the parts in order: text
parts are escaped, every other part (image, audio, document, ...) becomes a placeholder ``<|type|>`` (letters and underscores; what a type has else reads ``_``, and one that begins like the
template's own marks, ``im_``, is written ``part_im_``) and is recorded as an attachment
with its ordinal, reference and the number of tokens that the placeholder expands to (the part's own, else the default of its type).

Template of a turn: ``<|im_start|>role<|im_sep|>content<|im_end|>`` and a line feed. Control strings in roles and texts are
escaped by one more backslash after their first character: ``</s>`` is written ``<\\/s>``, ``<\\/s>`` is written ``<\\\\/s>``. No control
string of the template can then occur inside a text, and taking one backslash away restores it.

Loss mask: the content of assistant turns, as [start, end) code points of the formatted text.

Rows are ordered by turn (null first), then role and text, so ties and repeated rows have one result; null role, text, ref are
empty; a null conv_id is a conversation of its own; no rows give no conversations; extra columns are ignored. One
conversation is one output string, so its turns meet in one task; offsets are window sums, linear in the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrel.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings after their first character: any <|name|>, sentence marks and instruction marks.
CONTROL = r"\|[A-Za-z_]+\|>|/?s>|/?INST\]"
#: Tokens that a placeholder expands to where its part gives no number.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROL})", r"$1$2\\$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as the one part of its turn."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens"),
        )
    )


def is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def placeholder(kind: Column) -> Column:
    """The control string that stands for a part; never one of the template's own, and one that is escaped in texts."""
    name = F.regexp_replace(kind, "[^A-Za-z_]", "_")
    return F.concat(F.lit("<|"), F.when(F.lower(name).startswith("im_") | (name == ""), F.concat(F.lit("part_"), name)).otherwise(name), F.lit("|>"))


def flattened(parts: Column) -> Column:
    """The visitor: parts in order, texts escaped, others as placeholders."""
    visit = lambda p: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p["type"]))
    return F.concat_ws("", F.transform(F.coalesce(parts, F.array()), visit))


def attachments(parts: Column, defaults: dict[str, int] = DEFAULT_TOKENS) -> Column:
    """array<struct<ordinal, type, ref, n_tokens>> of the parts that are not text."""
    default = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    placed = F.transform(F.coalesce(parts, F.array()), lambda p, i: F.struct(i.alias("ordinal"), p.alias("part")))
    return F.transform(
        F.filter(placed, lambda x: ~is_text(x["part"])),
        lambda x: F.struct(
            x["ordinal"], x["part"]["type"].alias("type"), F.coalesce(x["part"]["ref"], F.lit("")).alias("ref"),
            F.coalesce(x["part"]["n_tokens"], F.try_element_at(default, x["part"]["type"]), F.lit(1)).cast("int").alias("n_tokens"),
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, parts) to one row per conversation.

    Returns conv_id, formatted, loss_mask array<struct<start, end>>, attachments array<struct<turn_index, ...>>, expanded_tokens.
    """
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flattened(F.col("parts")).alias("body"),
        attachments(F.col("parts")).alias("att"),
    )
    t = t.withColumn("head", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP)))
    t = t.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    t = t.withColumn("k", F.row_number().over(order)).withColumn("begin", F.sum(F.col("size").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    t = t.withColumn("start", F.col("begin") + F.length("head"))
    rows = F.sort_array(F.collect_list(F.struct("k", "role", "head", "body", "start", "att")))
    g = t.groupBy("conv_id").agg(rows.alias("rows"))
    mask = F.transform(
        F.filter("rows", lambda r: r["role"] == "assistant"),
        lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(r["body"])).alias("end")),
    )
    att = F.flatten(F.transform("rows", lambda r: F.transform(r["att"], lambda a: F.struct(
        (r["k"] - 1).alias("turn_index"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return g.select(
        "conv_id",
        F.concat_ws("", F.transform("rows", lambda r: F.concat(r["head"], r["body"], F.lit(END)))).alias("formatted"),
        mask.alias("loss_mask"), att.alias("attachments"),
        F.aggregate(att, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turn = r"(?s)^<\|im_start\|>(.*?)<\|im_sep\|>(.*)$"
    return F.transform(F.slice(pieces, 1, F.greatest(F.lit(0), F.size(pieces) - 1)), lambda x: F.struct(
        unescaped(F.regexp_extract(x, turn, 1)).alias("role"), unescaped(F.regexp_extract(x, turn, 2)).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped text of each span of the mask, in order, nothing between."""
    return F.concat_ws("", F.transform(mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))))


PROBE = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, then read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    out = format_chats(turns).select(
        "conv_id", "formatted", "attachments", "expanded_tokens", read_back(F.col("formatted")).alias("turns"),
        under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    )
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = """WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(\\|[A-Za-z_]+\\|>|/?s>|/?INST\\])', '\\1\\2\\\\\\3', 'g') AS body,
  regexp_replace(role, '([<\\[])(\\\\*)(\\|[A-Za-z_]+\\|>|/?s>|/?INST\\])', '\\1\\2\\\\\\3', 'g') AS erole FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(erole) + length(body) + 12 + 10 + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
