"""Chat formatting with DataFrame functions only.

Layouts are recognised by a fingerprint: the hash of the nested field paths of a row, of those that a layout
knows, sorted.  A row's paths are those of its JSON record if it has one, else its own columns.  The fingerprint
selects a declarative mapping that turns the layout's fields into canonical turns (role, text); the turns of
all rows of a conversation, whatever their layouts, make the conversation.  The template writes a turn as
[INST]role[/INST]text</s>; inside roles and texts a backslash is doubled and each control string gets one after
its first character, so no control string can stand in a text, the formatted text splits into turns without
doubt, and unescaping is exact.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROLS = ("</s>", "[INST]", "[/INST]")
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the fields it is known by.

    container/role/text: a list of messages, and the fields that may hold a message's role and text; pairs: (role,
    fields joined by a line feed) of flat records; row: (conversation, order, role, text) columns of turn rows.
    """

    name: str
    paths: tuple[str, ...]
    container: str = ""
    role: tuple[str, ...] = ("role", "from")
    text: tuple[str, ...] = ("content", "value")
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, ...] = ()


ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), row=("conv_id", "turn", "role", "text")),
    Layout("position_rows", ("content", "conversation_id", "position", "role"), row=("conversation_id", "position", "role", "content")),
    Layout("messages", ("messages", "messages.content", "messages.role"), "messages"),
    Layout("from_value", ("conversations", "conversations.from", "conversations.value"), "conversations"),
    Layout("instruction_input_output", ("input", "instruction", "output"), pairs=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_output", ("instruction", "output"), pairs=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system_prompt_response", ("prompt", "response", "system"), pairs=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_response", ("prompt", "response"), pairs=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), pairs=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("answer", "question"), pairs=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint_of(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(paths))))


def schema_paths(kind: T.DataType, above: str = "") -> list[str]:
    """All field paths of a schema, through structs and lists of structs."""
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind, above)
    fields = kind.fields if isinstance(kind, T.StructType) else []
    return [p for f in fields for p in (above + f.name, *schema_paths(f.dataType, f"{above}{f.name}."))]


def record_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The field paths of a JSON record: its own and, in the lists of messages that a layout knows, those of all elements."""
    none = F.array().cast("array<string>")

    def below(c: str) -> Column:
        items = F.from_json(F.get_json_object(record, f"$.{c}"), "array<map<string,string>>")
        return F.transform(F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), none))), lambda k: F.concat(F.lit(f"{c}."), k))

    lists = [F.coalesce(below(c), none) for c in sorted({x.container for x in layouts if x.container})]
    return F.array_distinct(F.concat(F.coalesce(F.json_object_keys(record), none), *lists))


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The fingerprint of the first layout, in the order given, whose fields are all among the paths; null: no layout's."""
    own = lambda x: F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, sorted(x.paths))))), ","))
    return F.coalesce(*[F.when(own(x) == fingerprint_of(x.paths), fingerprint_of(x.paths)) for x in layouts], F.lit(None).cast("long"))


def _message(x: Layout):
    def turn(m: Column) -> Column:
        role = F.coalesce(*[m[c] for c in x.role], F.lit(""))
        for old, new in ROLES.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(*[m[c] for c in x.text], F.lit("")).alias("text"))

    return turn


def mapped(x: Layout, record: Column, columns: set[str]) -> Column | None:
    """The canonical turns of a row of this layout; None if the table can't hold one."""
    value = lambda path: F.get_json_object(record, f"$.{path}")
    if x.row:
        if not set(x.row) <= columns:
            return None
        return F.array(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(x.row[2:], ("role", "text"))]))
    if x.container:
        kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in (*x.role, *x.text)]))
        return F.transform(F.coalesce(F.from_json(value(x.container), kind), F.array().cast(kind)), _message(x))
    made = F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*map(value, fields)), lambda v: v.isNotNull() & (v != "")), "\n").alias("text")) for role, fields in x.pairs])
    return F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != ""))


def with_turns(table: DataFrame, record_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout (null: none knows the row) and turns.  Rows without a known layout, and broken records, have no turns."""
    record = F.col(record_col).cast("string") if record_col else F.lit(None).cast("string")
    columns = set(table.columns)
    own = F.array(*map(F.lit, sorted(set(schema_paths(table.schema)) - {record_col}))).cast("array<string>")
    # Turn rows of a table are one layout at most; a record has no turn rows inside.
    rows, records = tuple(x for x in layouts if x.row), tuple(x for x in layouts if not x.row)
    found = table.withColumn("fingerprint", F.when(record.isNull(), fingerprint(own, rows)).otherwise(fingerprint(record_paths(record, records), records)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in reversed(layouts):
        made = mapped(x, record, columns)
        if made is not None:
            is_it = F.col("fingerprint") == fingerprint_of(x.paths)
            layout, turns = F.when(is_it, x.name).otherwise(layout), F.when(is_it, made.cast(TURNS)).otherwise(turns)
    return found.withColumns({"layout": layout, "turns": turns})


def turns_of_records(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns to JSON records; unknown, broken and null records have no turns."""
    return with_turns(records, record_col, tuple(x for x in layouts if not x.row))


def conversations(table: DataFrame, record_col: str | None = None) -> DataFrame:
    """conv_id, turns of a table of turn rows, of JSON records, or of both.

    Turn rows of a conversation are ordered by their order column, then role and text; a record's turns stand as it
    has them.  Null roles and texts are empty; all rows with a null conversation id are one conversation; equal rows
    are turns of their own; rows that no layout knows give none; extra columns are not read.  An empty table gives
    no conversations.  A table without records whose columns are no layout's is an error.
    """
    rows = [x for x in LAYOUTS if x.row and set(x.paths) <= set(schema_paths(table.schema))]
    if not rows and not record_col:
        raise ValueError(f"no layout of turn rows has the fields {table.columns}")
    conv, order = rows[0].row[:2] if rows else ("conv_id", None)
    at = F.col(order).cast("long") if order else F.lit(0).cast("long")
    names = [F.col(c) for c in {*(rows[0].row if rows else ()), conv, *((record_col,) if record_col else ())}]
    found = with_turns(table.select(*names), record_col).filter(F.size("turns") > 0)
    place = F.transform("turns", lambda t, i: F.struct(at.alias("at"), F.when(F.size("turns") > 1, i).otherwise(0).alias("i"), t["role"].alias("role"), t["text"].alias("text")))
    grouped = found.select(F.col(conv).alias("conv_id"), "fingerprint", place.alias("t")).groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def turns_of_rows(table: DataFrame) -> DataFrame:
    """conv_id, turns of a table with one row for each turn."""
    return conversations(table)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(chats: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds formatted, and mask: for each turn the characters before and under the loss mask, from the turn's start."""
    head = lambda t: F.concat(F.lit("[INST]"), escape(t["role"]), F.lit("[/INST]"))
    mask = lambda t: F.struct(F.length(head(t)).alias("skip"), F.when(t["role"] == "assistant", F.length(escape(t["text"]))).otherwise(F.lit(0)).alias("take"))
    return chats.withColumns({
        "formatted": F.array_join(F.transform(turns_col, lambda t: F.concat(head(t), escape(t["text"]), F.lit("</s>"))), ""),
        "mask": F.transform(turns_col, mask),
    })


def read_back(chats: DataFrame) -> DataFrame:
    """Adds read_turns and loss_text, from formatted and mask alone."""
    parts = F.split("formatted", "</s>")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(7)), "[/INST]", 1)).alias("role"),
        unescape(F.element_at(F.split(p, r"\[/INST\]", 2), 2)).alias("text"),
    )
    under = lambda p, m: unescape(F.substr(p, m["skip"] + 1, m["take"]))
    return chats.withColumns({"read_turns": F.transform(parts, turn), "loss_text": F.array_join(F.zip_with(parts, "mask", under), "")})


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations and conversation -7, formatted, and digests of what is read back."""
    said_twice = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": role, "content": said_twice} for role in ("user", "assistant")]})
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("record"))
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(extra).alias("record"))
    out = read_back(format_turns(conversations(rows.unionByName(more, allowMissingColumns=True), "record")))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
