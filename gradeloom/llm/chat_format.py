r"""Chat formatting: recognised layouts, declared mappings, one reversible template.

Records of different layouts (a prompt with its completion, an instruction with input and
output, lists of messages under several names) are told apart by a fingerprint: the hash of
their sorted field paths that hold a value. The fingerprint selects a declarative mapping to
canonical turns. A template then writes the turns between control strings:

    user       <s>[INST] text [/INST]
    assistant   text </s>
    other      <s>[ROLE role] text [/ROLE]

Inside texts and role names every backslash becomes two and a backslash is put into every
control string, so none is left there; reading back takes the backslashes out again. The
loss mask covers the texts of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeloom.llm.common import bind

#: The shape of canonical turns.
TURNS = "array<struct<role:string,text:string>>"

#: Field paths (lists marked with []) and how to read turns from them.
LAYOUTS = {
    ("messages[].content", "messages[].role"): ("messages", "role", "content"),
    ("messages[].role", "messages[].text"): ("messages", "role", "text"),
    ("conversations[].from", "conversations[].value"): ("conversations", "from", "value"),
    ("prompt", "response"): [("user", ["prompt"]), ("assistant", ["response"])],
    ("prompt", "completion"): [("user", ["prompt"]), ("assistant", ["completion"])],
    ("completion", "prompt", "system"): [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])],
    ("instruction", "output"): [("user", ["instruction"]), ("assistant", ["output"])],
    ("input", "instruction", "output"): [("user", ["instruction", "input"]), ("assistant", ["output"])],
}
#: Other names of roles, in layouts that have ``from`` in place of a role; elsewhere roles stay as they are given.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN_USER, CLOSE_USER, CLOSE_ANSWER = "<s>[INST] ", " [/INST]", " </s>"
OPEN_OTHER, CLOSE_OTHER = "<s>[ROLE ", " [/ROLE]"


def _paths(kind: T.DataType, name: str, value: Column) -> list[Column]:
    """Paths below ``value`` that hold something, each as a column that is null if it does not."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{name}.{f.name}" if name else f.name, value[f.name])]
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            held = lambda field: F.exists(value, lambda x: x[field].isNotNull())
            return [F.when(held(f.name), F.lit(f"{name}[].{f.name}")) for f in inner.fields]
        return [F.when(F.size(value) > 0, F.lit(f"{name}[]"))]
    return [F.when(value.isNotNull(), F.lit(name))]


def _digest(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def fingerprint(schema: T.StructType, ignore: tuple[str, ...] = ()) -> Column:
    """Hash of the sorted nested field paths that hold a value in a record."""
    found = [p for f in schema.fields if f.name not in ignore for p in _paths(f.dataType, f.name, F.col(f"`{f.name}`"))]
    return _digest(F.array_compact(F.array(*found)))


def canonical_turns(records: DataFrame, id_column: str = "conv_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Id, ``layout`` (the fingerprint) and ``turns`` of every record.

    Lists of messages keep their order; null messages, null roles and null texts are kept as
    a role or text that is empty. A record that holds nothing at all has no turns; one with
    another unknown layout has null turns, so that it can be found and mapped. ``extra``
    columns are no part of the layout.
    """
    names = {f.name: f.dataType for f in records.schema.fields}
    turns = F.lit(None).cast(TURNS)
    layout = F.col("layout")

    def message(role, text):
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def messages(value, role, text):
        others = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
        named = lambda m: F.coalesce(F.element_at(others, m), m) if role == "from" else m
        return F.transform(value, lambda m: message(named(m[role]), m[text]))

    for paths, mapping in LAYOUTS.items():
        if isinstance(mapping, tuple):
            field, role, text = mapping
            kind = names.get(field)
            if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {role, text} <= set(kind.elementType.names)):
                continue
            value = messages(F.col(f"`{field}`"), role, text)
        else:
            if not all(names.get(f) == T.StringType() for _, fields in mapping for f in fields):
                continue
            value = F.array(*[message(F.lit(role), F.concat_ws("\n\n", *[F.col(f"`{f}`") for f in fields])) for role, fields in mapping])
        turns = F.when(layout == F.sha2(F.lit("\n".join(sorted(paths))), 256), value.cast(TURNS)).otherwise(turns)
    turns = F.when(layout == F.sha2(F.lit(""), 256), F.array().cast(TURNS)).otherwise(turns)
    marked = records.withColumn("layout", fingerprint(records.schema, (id_column, *extra)))
    return marked.select(F.col(f"`{id_column}`"), *[F.col(f"`{c}`") for c in extra], "layout", turns.alias("turns"))


def messages_of_rows(rows: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as records with a list of messages, in the order of turns.

    A conversation is one record and has to fit into a row, as everywhere where a
    conversation is formatted. Ties of turns go by role and text, null turns first.
    Repeated rows are repeated turns.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    messages = F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return rows.groupBy(id_column).agg(messages.alias("messages"))


def escape(text: Column) -> Column:
    r"""Double backslashes, then break control strings with one: ``<\s>``, ``[\INST]``."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<|\[)(?=/*(?:s>|INST\]|ROLE[ \]]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _turn(turn: Column) -> Column:
    return (
        F.when(turn["role"] == "user", F.concat(F.lit(OPEN_USER), escape(turn["text"]), F.lit(CLOSE_USER)))
        .when(turn["role"] == "assistant", F.concat(F.lit(" "), escape(turn["text"]), F.lit(CLOSE_ANSWER)))
        .otherwise(F.concat(F.lit(OPEN_OTHER), F.replace(escape(turn["role"]), F.lit("]"), F.lit("\\]")), F.lit("] "), escape(turn["text"]), F.lit(CLOSE_OTHER)))
    )


def format_turns(turns: Column) -> Column:
    """``formatted`` and ``loss``: the spans (start, length in code points) of the assistant's texts, still escaped."""
    pieces = F.transform(turns, _turn)

    def add(state, item):
        piece, answer = item["piece"], item["answer"]
        size = F.char_length(piece)
        span = F.struct((state["at"] + 1).cast("int").alias("start"), (size - 1 - len(CLOSE_ANSWER)).cast("int").alias("length"))
        return F.struct(
            (state["at"] + size).cast("int").alias("at"),
            F.when(answer, F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"),
        )

    def spans(parts):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
        items = F.arrays_zip(parts.alias("piece"), F.transform(turns, lambda t: t["role"] == "assistant").alias("answer"))
        return F.struct(F.array_join(parts, "").alias("formatted"), F.aggregate(items, start, add)["loss"].alias("loss"))

    return bind(pieces, spans)


def pieces_of(formatted: Column) -> Column:
    """A formatted text cut behind its closing strings; each piece has lost its own."""
    return bind(F.split(formatted, r" \[/INST\]| </s>| \[/ROLE\]"), lambda found: F.slice(found, F.lit(1), F.size(found) - 1))


def read_back(pieces: Column) -> Column:
    """Turns from the pieces of a formatted text, told apart by their opening strings alone."""

    def turn(piece):
        role = F.regexp_extract(piece, r"^<s>\[ROLE ((?:[^\]\\]++|\\.)*+)\] ", 1)
        opening = (
            F.when(piece.startswith(OPEN_USER), len(OPEN_USER)).when(piece.startswith(OPEN_OTHER), len(OPEN_OTHER) + 2 + F.char_length(role)).otherwise(1)
        )
        name = F.when(piece.startswith(OPEN_USER), "user").when(piece.startswith(OPEN_OTHER), unescape(role)).otherwise("assistant")
        return F.struct(name.alias("role"), unescape(F.substring(piece, opening + 1, F.char_length(piece))).alias("text"))

    return F.transform(pieces, turn)


def under_mask(pieces: Column, loss: Column) -> Column:
    """The text under the loss spans, unescaped, read from the pieces: no text is scanned for the place of another."""
    closing = lambda piece: F.when(piece.startswith(OPEN_USER), len(CLOSE_USER)).when(piece.startswith(OPEN_OTHER), len(CLOSE_OTHER)).otherwise(len(CLOSE_ANSWER))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def after(state, piece):
        return F.struct(
            (state["at"] + F.char_length(piece) + closing(piece)).cast("int").alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")
        )

    starts = F.aggregate(pieces, none, after)["starts"]
    answers = F.filter(F.arrays_zip(pieces.alias("piece"), starts.alias("start")), lambda x: x["piece"].startswith(" "))
    spans = F.arrays_zip(answers.alias("answer"), loss.alias("span"))
    texts = F.transform(
        spans, lambda x: unescape(F.substring(x["answer"]["piece"], x["span"]["start"] - x["answer"]["start"] + 1, x["span"]["length"]))
    )
    return F.array_join(texts, "")


def format_chats(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Id, layout, canonical ``turns``, ``formatted`` text and ``loss`` spans of every record."""
    known = canonical_turns(records, id_column)
    done = known.withColumn("made", format_turns(F.col("turns")))
    return done.select(id_column, "layout", "turns", F.col("made.formatted").alias("formatted"), F.col("made.loss").alias("loss"))


def digests(chats: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What the output says when it is read back: counts and hashes of turns and of the text under the loss mask."""
    chats = chats.withColumn("pieces", pieces_of(F.col("formatted"))).withColumns(
        {"turns": read_back(F.col("pieces")), "under": under_mask(F.col("pieces"), F.col("loss"))}
    )
    turns, under = F.col("turns"), F.col("under")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        id_column,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
