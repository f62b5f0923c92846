"""Chat formatting by schema fingerprint, with DataFrame functions only.

`canonical` turns records of unlike layouts (prompt and response, instruction
records, lists of messages, one row a turn) into turns of (turn, role, text): the
nested field paths of the schema, sorted, are hashed, and the hash selects a
declarative mapping.  Only the paths of the layout are hashed: of the layouts whose
paths a schema all has, the one with most; null fields and empty lists have any
type, and other fields do not matter.  `canonical_json` does the same row by row
for JSON texts, by the schema of their variant value; a record of one turn is one
turn there.

`render` writes each conversation with a template that marks turns and replaces
control strings inside roles and texts reversibly, and gives the loss mask as
spans of code points; `parse` reads turns back from the written text, and
`masked` the text under the mask.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls
first), then role, then text; repeated rows are turns of their own; a
conversation is one row, whatever its length, because that is what is asked for;
rows of a null conversation id are one conversation.  Layouts that no mapping
knows, or that two of the same number of paths fit, raise an error (`canonical`)
or have null turns (`canonical_json`); a null list has no turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pick

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """A turn is written open, role, middle, text, close; `controls` are the strings that texts may not hold, `escape` the character that stands for them."""

    open: str = "<s>"
    middle: str = "[INST] "
    close: str = " [/INST]</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "␛"

    def escaped(self, text: Column) -> Column:
        """No control string is left: each is replaced by the escape character and its number."""
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape + "0"))
        for i, control in enumerate(self.controls, 1):
            text = F.replace(text, F.lit(control), F.lit(f"{self.escape}{chr(48 + i)}"))
        return text

    def unescaped(self, text: Column) -> Column:
        for i, control in enumerate(self.controls, 1):
            text = F.replace(text, F.lit(f"{self.escape}{chr(48 + i)}"), F.lit(control))
        return F.replace(text, F.lit(self.escape + "0"), F.lit(self.escape))


# ---- layouts

def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their types; elements of arrays are []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [f"{at}:{'text' if isinstance(kind, T.StringType) else 'number' if isinstance(kind, T.NumericType) else kind.typeName()}"]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


#: Field paths of a layout, and its turns as (role or a path to it, path to the text); "list" layouts give the list, and the fields in it, "turn" layouts the fields of a row.
LAYOUTS = {
    "prompt": (["prompt:text", "response:text"], [("user", "prompt"), ("assistant", "response")]),
    "completion": (["prompt:text", "completion:text"], [("user", "prompt"), ("assistant", "completion")]),
    "question": (["question:text", "answer:text"], [("user", "question"), ("assistant", "answer")]),
    "instruction": (["instruction:text", "output:text"], [("user", "instruction"), ("assistant", "output")]),
    "instruction input": (["instruction:text", "input:text", "output:text"], [("user", ("instruction", "input")), ("assistant", "output")]),
    "system prompt": (["system:text", "prompt:text", "response:text"], [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "messages": (["messages[].role:text", "messages[].content:text"], {"list": "messages", "role": "role", "text": "content"}),
    "conversations": (["conversations[].from:text", "conversations[].value:text"], {"list": "conversations", "role": "from", "text": "value"}),
    "row a turn": (["turn:number", "role:text", "text:text"], {"turn": "turn", "role": "role", "text": "text"}),
}
BY_PRINT = {fingerprint(found): turns for found, turns in LAYOUTS.values()}


def layout_print(found: list[str]) -> str | None:
    """The fingerprint of the layout that fits the paths."""
    given = dict(p.rsplit(":", 1) for p in found)

    def fits(path: str) -> bool:
        name, kind = path.rsplit(":", 1)
        whole = name.partition("[]")[0]
        return given.get(name) in (kind, "void") or "[]" in name and "void" in (given.get(whole), given.get(whole + "[]"))

    fit = sorted((own for own, _ in LAYOUTS.values() if all(map(fits, own))), key=len)
    return fingerprint(fit[-1]) if fit and (len(fit) == 1 or len(fit[-2]) < len(fit[-1])) else None


# Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "question": "user", "answer": "assistant"}


def role_name(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def _turns(mapping, get, items) -> Column:
    """Turns by a mapping; get(path) is a text, items(path, fields) a list of structs of texts."""
    if "turn" in mapping:
        return F.array(F.struct(F.coalesce(get(mapping["role"]), F.lit("")).alias("role"), F.coalesce(get(mapping["text"]), F.lit("")).alias("text")))
    if isinstance(mapping, dict):
        return F.transform(items(mapping["list"], (mapping["role"], mapping["text"])), lambda x: F.struct(role_name(x[mapping["role"]]).alias("role"), F.coalesce(x[mapping["text"]], F.lit("")).alias("text")))
    out = []
    for role, path in mapping:
        found = [path] if isinstance(path, str) else list(path)
        text = F.array_join(F.filter(F.array(*(F.coalesce(get(p), F.lit("")) for p in found)), lambda x: x != ""), "\n")
        out.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    whole = F.array(*out)
    return F.filter(whole, lambda x: (x["role"] != "system") | (x["text"] != ""))


def canonical(df: DataFrame, key: str) -> DataFrame:
    """key and turns (TURNS) of a table in one of the layouts; `key` is not part of the layout."""
    rest = T.StructType([f for f in df.schema if f.name != key])
    mapping = BY_PRINT.get(layout_print(paths(rest)))
    if mapping is None:
        raise ValueError("no mapping for the fields " + ", ".join(sorted(paths(rest))))
    if "turn" in mapping:
        return from_rows(df, conv_id=key, **mapping)

    def items(name: str, fields: tuple[str, ...]) -> Column:
        kind = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
        own = F.col(f"`{name}`")
        if any(p in paths(rest) for p in (f"{name}:void", f"{name}[]:void")):
            own = own.cast(kind)
        return F.coalesce(F.transform(own, lambda x: F.struct(*(x[f].cast("string").alias(f) for f in fields))), F.array().cast(kind))

    return df.select(F.col(f"`{key}`").alias("conv_id"), _turns(mapping, lambda p: F.col(f"`{p}`"), items).alias("turns"))


_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*|VOID)$"
_KINDS = {"text": "^(STRING|VOID)$", "number": _NUMBER}


def _fits(found: list[str]) -> Column:
    """Whether the record v has the paths; nulls and empty lists have any type."""

    def schema(v: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))

    out = F.lit(True)
    for name, _, kind in (p.rpartition(":") for p in found):
        whole, _, field = name.partition("[].")
        if not field:
            out &= F.coalesce(schema(F.col("v"), name).rlike(_KINDS[kind]), F.lit(False))
            continue
        items = F.try_variant_get("v", f"$.{whole}", "array<variant>")
        of_kind = lambda x: F.coalesce(F.schema_of_variant(x).rlike("^(OBJECT|VOID)") & F.coalesce(schema(x, field), F.lit("VOID")).rlike(_KINDS[kind]), F.lit(True))  # noqa: B023, E731
        good = F.forall(items, of_kind)
        some = (F.size(items) == 0) | F.exists(items, lambda x: schema(x, field).isNotNull())  # noqa: B023
        out &= F.coalesce((schema(F.col("v"), whole) == "VOID") | (good & some), F.lit(False))
    return out


def canonical_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, fingerprint (of the layout, else of the row's own schema) and turns of JSON records, each in a layout of its own."""
    value = F.try_parse_json(F.col(f"`{column}`"))
    rows = df.select(F.col(f"`{key}`").alias("conv_id"), value.alias("v"))
    found = F.array_compact(F.array(*(F.when(_fits(own), F.struct(F.lit(len(own)).alias("n"), F.lit(fingerprint(own)).alias("print"))) for own, _ in LAYOUTS.values())))
    rows = rows.withColumn("found", found).withColumn("most", F.array_max(F.transform("found", lambda x: x["n"])))
    rows = rows.withColumn("found", F.filter("found", lambda x: x["n"] == F.col("most")))
    rows = rows.withColumn("print", F.when(F.size("found") == 1, F.get("found", F.lit(0))["print"]).otherwise(F.sha2(F.schema_of_variant("v"), 256)))
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")

    def items(p: str, fields: tuple[str, ...]) -> Column:
        kind = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
        one = lambda x: F.struct(*(F.try_variant_get(x, f"$.{f}", "string").alias(f) for f in fields))
        return F.coalesce(F.transform(F.try_variant_get("v", f"$.{p}", "array<variant>"), one), F.array().cast(kind))

    turns = F.lit(None).cast(TURNS)
    for own, mapping in BY_PRINT.items():
        turns = F.when(F.col("print") == own, _turns(mapping, get, items)).otherwise(turns)
    return rows.select("conv_id", F.col("print").alias("fingerprint"), turns.alias("turns"))


def from_rows(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns of a table with one row a turn."""
    source = pick(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return source.groupBy("conv_id").agg(turns.alias("turns"))


# ---- writing and reading

def render(conversations: DataFrame, template: Template = Template(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, and loss (array of start and end): the texts of the learned roles."""
    written = F.transform("turns", lambda x: F.struct(F.concat(F.lit(template.open), template.escaped(x["role"]), F.lit(template.middle)).alias("head"), template.escaped(x["text"]).alias("body"), x["role"].isin(*learned).alias("learned")))
    pieces = F.transform("__turns", lambda x: F.concat(x["head"], x["body"], F.lit(template.close)))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def mark(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        return F.struct((end + len(template.close)).alias("at"), F.when(x["learned"], F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    loss = F.aggregate("__turns", F.struct(F.lit(0).alias("at"), none.alias("out")), mark)["out"]
    return conversations.withColumn("__turns", written).select("conv_id", F.array_join(pieces, "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """TURNS read back from the written text."""
    quoted = "\\Q" + template.close + "\\E"
    pieces = F.filter(F.split(formatted, quoted, -1), lambda p: p != "")
    middle, head = F.lit(template.middle), len(template.open)

    def read(piece: Column) -> Column:
        at = F.instr(piece, middle)
        return F.struct(template.unescaped(F.substring(piece, F.lit(head + 1), at - 1 - head)).alias("role"), template.unescaped(F.substring(piece, at + len(template.middle), F.length(piece))).alias("text"))

    return F.transform(pieces, read)


def masked(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """The unescaped text under the mask."""
    return F.array_join(F.transform(loss, lambda s: template.unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
