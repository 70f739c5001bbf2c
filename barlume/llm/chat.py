"""Chat formatting with schema fingerprints.

A record's fingerprint is the XXH64 of its sorted nested field paths that hold a value
(``messages[].role`` for a field of an array's elements). It selects one of the declared mappings,
which turn prompt, instruction and message layouts into one canonical form, an array of turns
(role, text). The template writes a turn as

    <|im_start|>role \\n text <|im_end|> \\n

and escapes role and text so that no control string can come from them: a backslash becomes two,
``<|`` becomes ``<\\|``, and in roles a line feed becomes backslash n. Reading it back undoes this exactly.
The loss mask lists the places of the assistants' texts. Everything is native expressions.

Defined results: a null role or text is empty; turns come by turn number (nulls first), then role and
text, so repeated rows stay; a null conversation id is a conversation of its own; a record whose
fingerprint no mapping knows has null turns; extra columns are ignored unless a mapping names their
path; ``schema_fingerprint``, ``canonical_turns``, ``formatted`` and ``loss_spans`` of the table itself are
replaced by the new columns of these names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from barlume.llm import spans

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


# --- schema fingerprints -------------------------------------------------------------------------


def _some(col: Column, field: str) -> Column:
    return F.exists(col, lambda x: x[field].isNotNull())


def _paths(col: Column, kind: DataType, path: str) -> list[Column]:
    """For each leaf below ``col``: its path where a value is there, else null."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _paths(col[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        out = []
        for f in kind.elementType.fields:
            out.append(F.when(_some(col, f.name), F.lit(f"{path}[].{f.name}")))
        return out
    return [F.when(col.isNotNull(), F.lit(path))]


def present_paths(df: DataFrame, columns: list[str]) -> Column:
    """The sorted nested paths of ``columns`` that hold a value in the row."""
    found = [x for c in columns for x in _paths(F.col(c), df.schema[c].dataType, c)]
    return F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None):
    def build() -> Column:
        def one(x: Column) -> Column:
            said = x[role]
            for a, b in (names or {}).items():
                said = F.when(x[role] == a, F.lit(b)).otherwise(said)
            return _turn(said, x[text])

        return F.transform(F.col(path), one)

    return build


def _pair(*parts: tuple[str, str]):
    return lambda: F.array(*(_turn(role, F.col(c)) for role, c in parts))


#: paths of a layout -> how it becomes turns. Declarative: a layout is a list of paths.
MAPPINGS: list[tuple[tuple[str, ...], object]] = [
    (("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    (("turns[].role", "turns[].text", "turns[].turn"), _list("turns", "role", "text")),
    (("turns[].role", "turns[].text"), _list("turns", "role", "text")),
    (("conversations[].from", "conversations[].value"), _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    (("completion", "prompt"), _pair(("user", "prompt"), ("assistant", "completion"))),
    (("prompt", "response"), _pair(("user", "prompt"), ("assistant", "response"))),
    (("prompt", "response", "system"), _pair(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    (("answer", "question"), _pair(("user", "question"), ("assistant", "answer"))),
    (("instruction", "output"), _pair(("user", "instruction"), ("assistant", "output"))),
    (
        ("input", "instruction", "output"),
        lambda: F.array(_turn("user", F.concat_ws("\n\n", "instruction", "input")), _turn("assistant", F.col("output"))),
    ),
]


def canonical(df: DataFrame, columns: list[str] | None = None, mappings: list | None = None) -> DataFrame:
    """``df`` with ``schema_fingerprint`` and ``canonical_turns`` (null where no mapping knows the layout).

    Looks at ``columns`` only (default: all columns that a mapping names).
    """
    mappings = mappings or MAPPINGS
    roots = {p.split(".")[0].split("[")[0] for paths, _ in mappings for p in paths}
    columns = columns or [c for c in df.columns if c in roots]
    mark = fingerprint(present_paths(df, columns))
    turns = F.lit(None).cast(TURNS)
    for paths, build in mappings:
        if {p.split(".")[0].split("[")[0] for p in paths} <= set(columns):
            try:
                df.select(build())
            except AnalysisException as e:  # the schema has no such fields, so no row has this layout
                if e.getCondition() is None or "FIELD" not in e.getCondition():
                    raise
                continue
            turns = F.when(mark == fingerprint(F.array_sort(F.array(*map(F.lit, paths)))), build()).otherwise(turns)
    filled = F.transform(turns, lambda x: F.struct(F.coalesce(x["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(x["text"].cast("string"), F.lit("")).alias("text")))
    return df.withColumns({"schema_fingerprint": mark, "canonical_turns": filled})


# --- template ------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    # an n after an odd number of backslashes was a line feed
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"))


def render(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, with the places of their escaped texts:
    array<struct<role, text, start, end>>, code points, end exclusive."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def one(p: Column) -> Column:
        cut = F.position(F.lit("\n"), p)
        return F.struct(
            unescape_role(F.substring(p, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
            unescape(F.substring(p, cut + 1, F.length(p))).alias("text"),
            cut.alias("lead"),
            F.length(p).alias("n"),
        )

    def place(held: Column) -> Column:
        before = spans.running(F.transform(held, lambda t: t["n"] + len(END)))
        return F.zip_with(
            held,
            before,
            lambda t, at: F.struct(t["role"].alias("role"), t["text"].alias("text"), (at + t["lead"]).alias("start"), (at + t["n"]).alias("end")),
        )

    return spans.bound(F.transform(pieces, one), place)


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the records of a table with a row per turn. A conversation is one row of the
    result whatever its length, since it is one text; rows meet in partial lists before the shuffle."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn), lambda a, b: _order(a, b)).alias("turns"))


def _order(a: Column, b: Column) -> Column:
    """By turn (nulls first), role, text."""
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    by_turn = F.when(a["turn"].isNull() & b["turn"].isNull(), 0).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1).otherwise(less(a["turn"], b["turn"]))
    by_role, by_text = less(a["role"], b["role"]), less(a["text"], b["text"])
    return F.when(by_turn != 0, by_turn).when(by_role != 0, by_role).otherwise(by_text)


def format_chat(records: DataFrame, columns: list[str] | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``records`` with ``formatted`` and ``loss_spans`` (the places of the texts of the roles in ``learn``)."""
    out = canonical(records, columns)
    out = out.withColumn("formatted", render(F.col("canonical_turns")))
    learnt = F.filter(parse(F.col("formatted")), lambda t: t["role"].isin(*learn))
    return out.withColumn("loss_spans", F.transform(learnt, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
