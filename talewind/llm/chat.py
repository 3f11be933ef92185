"""Conversations of many layouts as one training format. Column functions only.

A layout is a set of nested field paths; its hash (fingerprint) selects a declarative mapping to canonical turns. Tables are
recognised by their schema, JSON records each by its own keys. Formatting marks turns with control strings; those inside roles
and texts are escaped, reversibly, and the loss mask covers the texts of assistants.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. Either ``each`` names an array of turns with the fields ``role`` and ``text``, or ``turns`` lists
    (role, field) for the fields of one record, of which empty ones of ``skipped`` give no turn, or ``order`` names the field by
    which rows of one turn each are put in order."""

    name: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, str], ...] = ()
    skipped: tuple[str, ...] = ()
    order: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _listed(name: str, array: str, role: str, text: str) -> Mapping:
    return Mapping(name, (f"{array}[].{role}", f"{array}[].{text}"), each=array, role=role, text=text)


MAPPINGS = (
    Mapping("turn rows", ("turn", "role", "text"), role="role", text="text", order="turn"),
    _listed("messages", "messages", "role", "content"),
    _listed("from and value", "conversations", "from", "value"),
    _listed("dialogue", "dialog", "speaker", "utterance"),
    Mapping("prompt and response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")), skipped=("input",)),
    Mapping("system and instruction", ("system", "instruction", "output"), turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")), skipped=("system",)),
    Mapping(
        "system and instruction with input", ("system", "instruction", "input", "output"),
        turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), skipped=("system", "input"),
    ),
    Mapping("system, prompt and response", ("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), skipped=("system",)),
)
#: Names that other layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def nested_paths(kind: DataType, at: str = "") -> list[str]:
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return nested_paths(kind.elementType, f"{at}[]")
    return [at]


def mapping_for(kind: StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint equals that of its own paths among the schema's. Other columns do no harm, also where they have
    names of other mappings: the mapping of most paths is taken, of as many the first."""
    found = set(nested_paths(kind))
    for m in by_paths(mappings):
        if m.fingerprint == fingerprint_of(found & set(m.paths)):
            return m
    raise ValueError(f"no mapping for the layout {sorted(found)}")


def by_paths(mappings: tuple[Mapping, ...]) -> list[Mapping]:
    """Mappings of most paths first."""
    return sorted(mappings, key=lambda m: -len(m.paths))


def _canonical(role: Column) -> Column:
    named = role
    for given, canonical in ROLES.items():
        named = F.when(role == given, F.lit(canonical)).otherwise(named)
    return named


def _turn(at: Column, role: Column, text: Column) -> Column:
    return F.struct(at.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(m: Mapping, field) -> Column:
    """Array of turns of one record; ``field`` gives the column of a field's name."""
    if m.order:
        return F.array(_turn(field(m.order), field(m.role), field(m.text)))
    if m.each:
        return F.transform(field(m.each), lambda x, i: _turn(i, _canonical(x[m.role]), x[m.text]))
    every = F.array(*(_turn(F.lit(i), F.lit(role), field(name)) for i, (role, name) in enumerate(m.turns)))
    skip = [i for i, (_, name) in enumerate(m.turns) if name in m.skipped]
    return F.filter(every, lambda t: ~(t["turn"].isin(skip) & (t["text"] == ""))) if skip else every


def turns_of_table(df: DataFrame, id_column: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id and turns (array of turn, role, text) for each row of a table whose schema has a known layout; one that has none is
    an error. A null role or text is empty, a null conv_id or turn stays null, a null array of turns stays null; an empty table
    gives no rows. Other columns are not read."""
    m = mapping_for(df.schema, mappings)
    return df.select(F.col(id_column).cast("long").alias("conv_id"), _turns(m, F.col).alias("turns"))


def turns_of_json(df: DataFrame, record: str = "record", id_column: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, layout and turns for each JSON record, whatever its layout. The keys of all elements of an array count, and keys that
    the taken mapping does not name are passed over. Null and broken records and unknown layouts have null for layout and turns."""
    arrays = sorted({p.split("[].")[0] for m in mappings for p in m.paths if "[]." in p})
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    elements = lambda a: F.coalesce(F.from_json(F.get_json_object(record, f"$.{a}"), "array<string>"), F.array().cast("array<string>"))
    inner = [F.transform(F.flatten(F.transform(elements(a), keys)), _prefixed(f"{a}[].")) for a in arrays]
    rows = df.select(F.col(id_column).cast("long").alias("conv_id"), F.col(record).alias("record"), F.array_distinct(F.concat(keys(F.col(record)), *inner)).alias("paths"))

    def parsed(m: Mapping) -> Column:
        if m.each:
            kind = f"struct<{m.each}:array<struct<{m.role}:string,{m.text}:string>>>"
        else:
            kind = "struct<" + ",".join(f"{p}:string" for p in m.paths) + ">"
        value = F.from_json("record", kind)
        return _turns(m, lambda name: value[name])

    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    # The last one put in front is tried first.
    for m in reversed(by_paths(mappings)):
        found = F.sha2(F.array_join(F.array_sort(F.filter("paths", _among(list(m.paths)))), "\n"), 256) == m.fingerprint
        layout = F.when(found, F.lit(m.name)).otherwise(layout)
        turns = F.when(found, parsed(m)).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def _among(names: list[str]):
    return lambda k: k.isin(names)


def _prefixed(prefix: str):
    return lambda k: F.concat(F.lit(prefix), k)


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained: str = "assistant"


TEMPLATE = Template()
#: Control strings of the usual templates begin with < or [; a role ends at a line end. & comes first, and last on the way back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escaped(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def formatted(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments (array of text and loss, whose texts joined are the whole) and formatted, from rows of conv_id and turns.

    A conversation's turns may come in many rows; they are put in order of turn (null first), then role and text where turns
    tie; repeated rows stay. Null roles and texts are empty; rows with a null conv_id are one conversation; no rows give none.
    Null turns (records of unknown layout) add none: a conversation of these alone is an empty string without segments. A
    conversation is one row of the result, so it is held by one task.
    """
    each = turns.select("conv_id", F.explode_outer("turns").alias("t"))
    rows = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(template.begin), escaped(t["role"], ROLE_ESCAPES), F.lit("\n"))
        loss = t["role"] == template.trained
        part = lambda text, mask: F.struct(text.alias("text"), mask.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escaped(t["text"]), loss), part(F.lit(template.end + "\n"), F.lit(False)))

    out = rows.select("conv_id", F.flatten(F.transform("t", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join("segments.text", ""))


def read_back(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the format says: conv_id, turns (role and text) read from the whole string, and the text under the loss mask."""
    marks = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in template.begin)
    pieces = F.slice(F.split("formatted", marks, -1), 2, F.greatest(F.size(F.split("formatted", marks, -1)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(template.end))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), "formatted")


def digest(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    back = read_back(chats, template)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
