"""Chat formatting by schema fingerprints, in DataFrame operations only.

The nested field paths that a mapping needs, sorted, are hashed to its fingerprint. A table whose own paths have a
known fingerprint takes that mapping; in a table of more paths, each row takes the first known mapping, by number
of paths and then by the order of ``LAYOUTS``, of which it has all columns. Mappings are declarative: they turn a
layout (prompt and response, instruction with input and output, lists of messages, messages as JSON, a row a turn)
into canonical turns ``array<struct<role, text>>``. A template then writes

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

for each turn. Control strings in texts are escaped with U+2060: every U+2060 is doubled, then ``<|`` becomes
``<`` U+2060 ``|``; reading back undoes both. In roles, line feeds are escaped too. The loss mask is a list of
spans (start, length in code points) over the formatted string: the assistant's texts, once each, in order.

Defined cases: null text and null role are empty; a conversation's rows go by turn (null first), then role
and text, so ties and repeated rows have one order; null conversation ids form one conversation; an empty
table gives no rows; columns that the mapping doesn't name are dropped, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
MARK = "\u2060"
TURNS = "array<struct<role:string,text:string>>"
ASSISTANT = "assistant"


# --- layouts ------------------------------------------------------------------------------------


def field_paths(schema: T.StructType) -> list[str]:
    """Sorted nested paths, ``[]`` for list elements, ``{}`` for maps, whose keys aren't in the schema; other types don't count."""

    def walk(t, at: str):
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from walk(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())
        elif isinstance(t, T.ArrayType):
            yield from walk(t.elementType, f"{at}[]")
        elif isinstance(t, T.MapType):
            yield f"{at}{{}}"
        else:
            yield at

    return sorted(set(walk(schema, "")))


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.cast("string").alias("text"))


def _turns(*turns: Column) -> Column:
    return F.filter(F.array(*turns), lambda t: t.text.isNotNull()).cast(TURNS)


def _messages(column: Column, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(m):
        r = m[role].cast("string")
        if names:
            r = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), r), r)
        return F.struct(r.alias("role"), m[text].cast("string").alias("text"))

    return F.transform(F.coalesce(column, F.array()), one).cast(TURNS)


_SHARE = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT}



def _json_messages(column: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    """Messages in a JSON string; a string that isn't such a list has no turns."""
    m = F.coalesce(F.from_json(F.col(column), f"array<struct<`{role}`:string,`{text}`:string>>"), F.array())
    return _messages(m, role, text, names)


def _asked(question: Column, answer: str, system: str | None = None) -> Column:
    first = [_turn("system", F.col(system))] if system else []
    return _turns(*first, _turn("user", question), _turn(ASSISTANT, F.col(answer)))


def _with_input() -> Column:
    joined = F.concat_ws("\n\n", "instruction", "input")
    return F.when(F.length(F.col("input")) > 0, joined).otherwise(F.col("instruction"))


def _row_turns() -> Column:
    """Turns of rows, a row a turn: an aggregate over the rows of a conversation."""
    t = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return F.transform(F.sort_array(F.collect_list(t)), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))


@dataclass(frozen=True)
class Layout:
    """The paths that rows must have, what makes turns of them, and the column that rows are grouped by, if any."""

    paths: tuple[str, ...]
    turns: Callable[[], Column]
    grouped_by: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))

    @property
    def columns(self) -> list[str]:
        return sorted({re.match(r"[^.\[{]+", p)[0] for p in self.paths})


LAYOUTS = [
    Layout(("conv_id", "turn", "role", "text"), _row_turns, "conv_id"),
    Layout(("messages[].content", "messages[].role"), lambda: _messages(F.col("messages"), "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), lambda: _messages(F.col("conversations"), "from", "value", _SHARE)),
    Layout(("instruction", "input", "output"), lambda: _asked(_with_input(), "output")),
    Layout(("system", "prompt", "response"), lambda: _asked(F.col("prompt"), "response", "system")),
    Layout(("instruction", "output"), lambda: _asked(F.col("instruction"), "output")),
    Layout(("instruction", "response"), lambda: _asked(F.col("instruction"), "response")),
    Layout(("prompt", "response"), lambda: _asked(F.col("prompt"), "response")),
    Layout(("prompt", "completion"), lambda: _asked(F.col("prompt"), "completion")),
    Layout(("question", "answer"), lambda: _asked(F.col("question"), "answer")),
    Layout(("messages[]{}",), lambda: _messages(F.col("messages"), "role", "content")),
    Layout(("conversations[]{}",), lambda: _messages(F.col("conversations"), "from", "value", _SHARE)),
    Layout(("messages",), lambda: _json_messages("messages", "role", "content")),
    Layout(("conversations",), lambda: _json_messages("conversations", "from", "value", _SHARE)),
]
BY_FINGERPRINT = {x.fingerprint: x for x in LAYOUTS}


def select_layouts(schema: T.StructType) -> list[Layout]:
    """The mapping of the table's own fingerprint, or all that its paths allow, most paths first."""
    paths = field_paths(schema)
    own = BY_FINGERPRINT.get(fingerprint(paths))
    fits = [own] if own else sorted((x for x in LAYOUTS if set(x.paths) <= set(paths)), key=lambda x: -len(x.paths))
    if not fits:
        raise ValueError(f"no mapping for the layout {fingerprint(paths)}: {', '.join(paths)}")
    return fits[:1] if fits[0].grouped_by else [x for x in fits if not x.grouped_by]


def canonical(df: DataFrame) -> DataFrame:
    """(conv_id, fingerprint, turns) of any known layout; tables with a row a conversation keep ``conv_id`` or ``id`` if they have it."""
    layouts = select_layouts(df.schema)
    first = layouts[0]
    if first.grouped_by:
        d = df.groupBy(F.col(first.grouped_by).alias("conv_id")).agg(first.turns().alias("turns"))
        return d.select("conv_id", F.lit(first.fingerprint).alias("fingerprint"), "turns")

    def chosen(value) -> Column:
        """By the row's layout: the first of which no column is null, else the first of all."""
        out = value(first)
        for x in reversed(layouts if len(layouts) > 1 else []):
            has_all = reduce(and_, [F.col(c).isNotNull() for c in x.columns])
            out = F.when(has_all, value(x)).otherwise(out)
        return out

    turns = F.transform(chosen(lambda x: x.turns()), lambda x: F.struct(F.coalesce(x.role, F.lit("")).alias("role"), F.coalesce(x.text, F.lit("")).alias("text")))
    key = next((c for c in df.columns if c.lower() in ("conv_id", "id")), None)
    ident = F.col(key) if key else F.xxhash64(turns)
    return df.select(ident.alias("conv_id"), chosen(lambda x: F.lit(x.fingerprint)).alias("fingerprint"), turns.alias("turns"))


# --- template -----------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK), F.lit(MARK * 2)), F.lit("<|"), F.lit(f"<{MARK}|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"<{MARK}|"), F.lit("<|")), F.lit(MARK * 2), F.lit(MARK))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(f"{MARK}n"))


def unescape_role(role: Column) -> Column:
    """U+2060 n is a line feed only where the mark isn't itself the second of a pair."""
    return unescape(F.regexp_replace(role, f"(?<!{MARK})((?:{MARK}{MARK})*){MARK}n", "$1\n"))


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"), escape(t.text), F.lit(f"{END}\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted string, as escaped as they stand, with where their texts start."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: F.length(p) > 0)
    step = lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), F.length(p).alias("n"), p.alias("part"))
    cut = lambda x: F.struct(x.role.alias("role"), x.part.substr(F.length(x.role) + 2, x.n - F.length(x.role) - F.lit(len(END) + 2)).alias("text"), x.n.alias("n"))
    return F.transform(F.transform(parts, step), cut)


def loss_spans(parsed: Column) -> Column:
    """(start, length) of the assistant's texts in the formatted string, in code points from 0."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc, t):
        start = acc.at + F.lit(len(START) + 1) + F.length(t.role)
        span = F.array(F.struct(start.cast("int").alias("start"), F.length(t.text).alias("length")))
        return F.struct((acc.at + F.lit(len(START)) + t.n).cast("int").alias("at"), F.when(t.role == ASSISTANT, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(parsed, zero, add, lambda a: a.spans)


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, fingerprint, formatted, loss_mask) of a table in any known layout."""
    d = canonical(df).select("conv_id", "fingerprint", render(F.col("turns")).alias("formatted"))
    return d.select("conv_id", "fingerprint", "formatted", loss_spans(parse(F.col("formatted"))).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from formatted strings and their masks alone."""
    f = F.col("formatted")
    turns = F.transform(parse(f), lambda t: F.struct(unescape_role(t.role).alias("role"), unescape(t.text).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(f.substr(s.start + 1, s.length))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length(f).cast("long").alias("formatted_chars"))
