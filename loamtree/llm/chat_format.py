"""Chat formatting by sorted turn structs and Spark expressions only."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: The template's own marks, then control strings of common chat formats that texts may not smuggle in.
TURN, HEAD, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]


def escape(text):
    r"""Doubles each backslash, then puts one behind the first character of each control string. unescape() is its inverse."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start and length in code points).

    The turns of a conversation are collected as structs and sorted by turn,
    then role, then text; nulls come first, and a null role or text counts as
    empty. Adjacent turns of one role share a block, whose parts stay apart by
    a mark, so the turns can be read back. The mask has each assistant text.

    A null conversation id is a conversation of its own; a repeated row is a
    turn of its own; no rows give no rows. Other columns are ignored. All turns
    of a conversation meet in one task, as they are one row; its work is
    proportional to them.
    """
    item = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))

    def piece(t, i):
        joins = (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"])
        opening = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(t["role"]), F.lit(HEAD))
        return F.struct(F.when(joins, F.lit(PART)).otherwise(opening).alias("before"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("learnt"))

    pieces = chats.select("conv_id", F.posexplode(F.transform("turns", piece)).alias("i", "p"))
    # starts by running sums over the rows of a conversation, which are together already: no array grows turn by turn
    earlier = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("p.before") + F.length("p.text").cast("long")
    placed = pieces.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("p.before"))
    row = F.struct("i", F.concat("p.before", "p.text").alias("piece"), "p.learnt", "start", F.length("p.text").cast("long").alias("length"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    learnt = F.transform(F.filter("rows", lambda r: r["learnt"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return whole.select("conv_id", F.concat(F.array_join(F.transform("rows", lambda r: r["piece"]), ""), F.lit(END)).alias("formatted"), learnt.alias("loss_mask"))


#: Characters of the parts that a text is cut into before spans are taken from it, and of the larger parts cut first.
PART_SIZE, LARGE_PART = 1 << 12, 1 << 16


def spans_of(text, spans):
    """The substring of each span of code points (start, length). A span is sought in parts of the text, not from its beginning."""
    cut = lambda t, size, last: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * size + 1, F.lit(size)))
    large = cut(text, LARGE_PART, (F.length(text) / LARGE_PART).cast("int"))
    parts = F.flatten(F.transform(large, lambda t: cut(t, PART_SIZE, F.lit(LARGE_PART // PART_SIZE - 1))))

    def take(m, parts):
        first, last = F.floor(m["start"] / PART_SIZE), F.floor((m["start"] + m["length"]) / PART_SIZE)
        near = F.array_join(F.slice(parts, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.substring(near, (m["start"] % PART_SIZE + 1).cast("int"), m["length"].cast("int"))

    # bound to a variable, the parts are made once and not for every span
    return F.flatten(F.transform(F.array(F.struct(parts.alias("parts"), spans.alias("spans"))), lambda z: F.transform(z["spans"], lambda m: take(m, z["parts"]))))


def parse_chats(chats: DataFrame) -> DataFrame:
    """chats with turns (role and text, read back from `formatted` alone) and loss_text (all text under the mask, unescaped)."""
    quoted = lambda mark: "\\Q" + mark + "\\E"
    opened = F.split("formatted", quoted(TURN), -1)
    blocks = F.slice(opened, F.lit(2), F.size(opened) - 1)

    def block_turns(b):
        role = unescape(F.substring_index(b, HEAD, 1))
        body = F.get(F.split(b, quoted(HEAD), 2), F.lit(1))
        parts = F.split(F.regexp_replace(body, quoted(END) + "$", ""), quoted(PART), -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    learnt = F.transform(spans_of(F.col("formatted"), F.col("loss_mask")), unescape)
    return chats.withColumns({"turns": F.flatten(F.transform(blocks, block_turns)), "loss_text": F.array_join(learnt, "")})


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT -7L AS conv_id, t.* FROM VALUES (0L, 'user', '{said}'), (1L, 'assistant', '{said}') AS t(turn, role, text)")
    read_back = parse_chats(format_chats(turns.unionByName(planted)))
    spelled = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spelled, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return out


OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST({len(END)} + sum(length({_sql_escape('text')}) + CASE
    WHEN n = 1 THEN {len(TURN + HEAD)} + length({_sql_escape('role')})
    WHEN before = role THEN {len(PART)}
    ELSE {len(END + TURN + HEAD)} + length({_sql_escape('role')}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
