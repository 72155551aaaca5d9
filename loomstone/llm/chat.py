"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is known by the hash of its nested field paths. Each registered layout has a declarative
mapping (plain SQL expressions) to canonical turns, an array of (role, text). Tables of one layout are
recognised by their schema; JSON records of mixed layouts by the schema of each value.

Format. A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. A control string inside a role or text gets one
backslash after its first character, and one that already has backslashes there gets one more, so the
escape can be undone exactly. Per cent signs and line ends in roles are per-cent encoded.

A table with columns beside those of its layout takes the layout whose paths it holds; where it holds those of
several, the one with the most paths, then the first in LAYOUTS.

Null roles and texts are empty. Turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one defined order; rows with a null conversation id form one conversation. An
unknown layout raises (tables) or gives no turns and a null layout (JSON records). An empty table gives
an empty result. Columns outside the mapping are left out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]).replace("/", r"\/") for c in CONTROLS)
_INSIDE = rf"([<\[])(\\*)({_REST})"
_ESCAPED = rf"([<\[])\\(\\*)({_REST})"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with the kind of each leaf: number, text, other; [] marks an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [f"{at}:{'text' if isinstance(kind, T.StringType) else 'number' if isinstance(kind, T.NumericType) else 'other'}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """turns: an SQL expression for array<struct<role, text>>; or role, text and order columns of one row a turn."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    key: str = ""
    order: str = ""
    role: str = ""
    text: str = ""


def _one(role: str, field: str) -> str:
    return f"named_struct('role', '{role}', 'text', {field})"


LAYOUTS = (
    Layout("turn rows", ("conv_id:number", "turn:number", "role:text", "text:text"), key="conv_id", order="turn", role="role", text="text"),
    Layout("prompt and response", ("prompt:text", "response:text"), f"array({_one('user', 'prompt')}, {_one('assistant', 'response')})"),
    Layout("prompt and completion", ("prompt:text", "completion:text"), f"array({_one('user', 'prompt')}, {_one('assistant', 'completion')})"),
    Layout(
        "instruction", ("instruction:text", "input:text", "output:text"),
        f"array({_one('user', "concat(instruction, if(coalesce(input, '') = '', '', concat('\\n', input)))")}, {_one('assistant', 'output')})",
    ),
    Layout("instruction without input", ("instruction:text", "output:text"), f"array({_one('user', 'instruction')}, {_one('assistant', 'output')})"),
    Layout("messages", ("messages[].role:text", "messages[].content:text"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout(
        "conversations", ("conversations[].from:text", "conversations[].value:text"),
        "transform(conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))",
    ),
)
BY_PRINT = {fingerprint(list(x.paths)): x for x in LAYOUTS}
_TURNS = "array<struct<role string, text string>>"


def layout_of(schema: T.StructType, ignore: tuple[str, ...] = ()) -> Layout:
    """The registered layout of a table; `ignore` names extra columns."""
    kept = T.StructType([f for f in schema.fields if f.name not in ignore])
    found = BY_PRINT.get(fingerprint(field_paths(kept)))
    if found:
        return found
    paths = field_paths(schema)
    fits = [x for x in LAYOUTS if set(x.paths) <= set(paths)]  # a table may have columns besides those of its layout
    if not fits:
        raise ValueError(f"no layout for {sorted(paths)}")
    return max(fits, key=lambda x: len(x.paths))


def canonical(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, turns) of a table in any registered layout; `key` names the id of one-row layouts."""
    x = layout_of(df.schema, (key,))
    clean = "transform(%s, t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))"
    if x.key:
        rows = df.select(F.col(x.key).alias("id"), F.struct(F.col(x.order).alias("o"), F.col(x.role).alias("role"), F.col(x.text).alias("text")).alias("t"))
        grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        return grouped.select("id", F.expr(clean % "turns").cast(_TURNS).alias("turns"))
    return df.select(F.col(key).alias("id"), F.expr(clean % f"({x.turns})").cast(_TURNS).alias("turns"))


_KINDS = ((r"\b(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9, ]*\))", "NUMBER"), (r"\bVOID\b", "STRING"))


def _variant_print(value: Column) -> Column:
    """The hash of a variant's nested field names and kinds."""
    shape = F.schema_of_variant(value)
    for pattern, to in _KINDS:
        shape = F.regexp_replace(shape, pattern, to)
    return F.sha2(shape, 256)


def _variant_shape(x: Layout) -> tuple[str, str]:
    """(the schema text of a variant in this layout, the Spark type to read it with)."""
    if "[]" in x.paths[0]:
        top = x.paths[0].split("[]")[0]
        names = sorted(p.split("[].")[1].split(":")[0] for p in x.paths)
        return f"OBJECT<{top}: ARRAY<OBJECT<{', '.join(f'{n}: STRING' for n in names)}>>>", f"struct<{top}: array<struct<{', '.join(f'`{n}`: string' for n in names)}>>>"
    names = sorted(p.split(":")[0] for p in x.paths)
    return f"OBJECT<{', '.join(f'{n}: STRING' for n in names)}>", f"struct<{', '.join(f'`{n}`: string' for n in names)}>"


def canonical_json(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(id, layout, turns) of JSON records of mixed layouts: each row's fingerprint selects its mapping."""
    rows = df.select(F.col(key).alias("id"), F.col(payload).alias("_json"), F.try_parse_json(F.col(payload)).alias("_v"))
    rows = rows.withColumn("_print", _variant_print(F.col("_v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for x in LAYOUTS:
        if not x.key:
            shape, kind = _variant_shape(x)
            mine = F.col("_print") == hashlib.sha256(shape.encode()).hexdigest()
            name = F.when(mine, x.name).otherwise(name)
            fields = [p.split("[]")[0].split(":")[0] for p in x.paths]
            mapped = x.turns
            for f in dict.fromkeys(fields):
                mapped = re.sub(rf"(?<![\w.'`]){f}(?![\w'(])", f"_r_{x.name.replace(' ', '_')}.`{f}`", mapped)
            rows = rows.withColumn(f"_r_{x.name.replace(' ', '_')}", F.when(mine, F.from_json("_json", kind)))
            clean = f"transform({mapped}, t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))"
            turns = F.when(mine, F.expr(clean).cast(_TURNS)).otherwise(turns)
    return rows.select("id", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _INSIDE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_in(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame) -> DataFrame:
    """(id, formatted, loss_spans) of (id, turns): loss spans are (start, end) code points of assistant texts."""
    head = F.transform("turns", lambda t: F.concat(F.lit(START), _role_in(t["role"]), F.lit("\n")))
    body = F.transform("turns", lambda t: escape(t["text"]))
    parts = F.arrays_zip(head.alias("h"), body.alias("b"), F.transform("turns", lambda t: t["role"] == "assistant").alias("a"))
    out = turns.select("id", parts.alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["h"], x["b"], F.lit(END + "\n"))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start long, end long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["h"])
        end = start + F.char_length(x["b"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(END) + 1).cast("long").alias("at"), F.when(x["a"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return out.select("id", whole.alias("formatted"), F.aggregate("p", zero, step)["spans"].alias("loss_spans"))


def read_back(df: DataFrame) -> DataFrame:
    """(id, formatted, turns, loss_texts) from (id, formatted, loss_spans) alone."""
    pieces = F.split(F.col("formatted"), re.escape(END + "\n"))
    pieces = F.filter(pieces, lambda x: x != "")
    inner = F.transform(pieces, lambda x: F.substr(x, F.lit(len(START) + 1)))
    turns = F.transform(
        inner,
        lambda x: F.struct(
            _role_out(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return df.select("id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def digests(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of read_back()'s rows."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return df.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(text, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_digests(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of conversation -7, whose texts are control strings. Each table
    takes the mapping that its fingerprint selects: turns by row, and a prompt with its response."""
    probe = conversations.sparkSession.sql("SELECT -7L AS id, '</s>[INST] ok [/INST]' AS prompt, '</s>[INST] ok [/INST]' AS response")
    turns = canonical(conversations).select(F.col("id").cast("long").alias("id"), "turns").unionByName(canonical(probe))
    return digests(read_back(formatted(turns)))


def chat_layouts(conversations: DataFrame) -> DataFrame:
    """conv_id, layout, n_turns, turns_sha256 of the conversations as JSON records of three layouts, read back by
    the fingerprint of each record. Every third conversation is an instruction (its first text) with an output
    (its last), the others are whole."""
    turns = canonical(conversations).select(F.col("id").cast("long").alias("id"), "turns")
    third = F.pmod("id", F.lit(3))
    messages = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    said = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))
    task = F.to_json(F.struct(F.element_at("turns", 1)["text"].alias("instruction"), F.element_at("turns", -1)["text"].alias("output")))
    record = F.when(third == 0, messages).when(third == 1, F.to_json(F.struct(said.alias("conversations")))).otherwise(task)
    got = canonical_json(turns.select("id", record.alias("record")), "id", "record")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(F.col("id").alias("conv_id"), "layout", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(text, "UTF-8"), 256).alias("turns_sha256"))


_STARTS = "".join(sorted({"\\" + c[0] for c in CONTROLS}))
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), made AS (
  SELECT *, regexp_replace(text, '{_INSIDE}', '\\1\\\\\\2\\3', 'g') AS escaped,
         regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{_INSIDE}', '\\1\\\\\\2\\3', 'g') AS shown
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(shown) + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
LAYOUTS_ORACLE = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' ELSE 'instruction without input' END AS layout,
  CASE WHEN conv_id % 3 = 2 THEN 2 ELSE count(*) END AS n_turns,
  sha256(CASE WHEN conv_id % 3 = 2 THEN 'user' || chr(10) || arg_min(text, k) || chr(10) || 'assistant' || chr(10) || arg_max(text, k) || chr(10)
    ELSE string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) END) AS turns_sha256
FROM r GROUP BY conv_id
"""
