"""Structure from source text: modules, ports, signals, instances, blocks, state machines, memories, buses.

Extractors work on (module, text) rows, comments removed where they would mislead, and give rows. Patterns that
one regular expression holds are built-in functions; extractors that need state over a text run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import strip_comments

IDENT = "[A-Za-z_][A-Za-z0-9_]*"
#: Words of the language that aren't names: fixed values.
RESERVED = frozenset(
    "module endmodule input output inout wire reg logic assign always initial begin end if else case casex casez endcase default for while posedge negedge or and not parameter localparam "
    "function endfunction task endtask generate endgenerate genvar integer signed".split()
)


def modules(files: DataFrame, text: str = "text") -> DataFrame:
    """(…, module, body): each module of a file up to its end."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?ms)^\s*module\s+{IDENT}.*?\bendmodule\b"), F.lit(0))
    d = files.withColumn("body", F.explode(found))
    return d.withColumn("module", F.regexp_extract("body", rf"module\s+({IDENT})", 1)).drop(text)


def _each(df: DataFrame, f: Callable[[str, str], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of f(module, body), in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for m, b in zip(pdf["module"], pdf["body"]) for r in f(m, b or "")]
            yield pd.DataFrame(rows, columns=names)

    return df.select("module", "body").mapInPandas(run, schema)


def _width(expr: str | None) -> int | None:
    m = re.fullmatch(r"\s*\[\s*(\d+)\s*:\s*(\d+)\s*\]\s*", expr or "")
    return abs(int(m[1]) - int(m[2])) + 1 if m else (1 if not expr else None)


def _bare(body: str) -> str:
    return re.sub(r"//[^\n]*", "", re.sub(r"/\*.*?\*/", "", body, flags=re.S))


def ports(df: DataFrame) -> DataFrame:
    """Ports with direction, width and the comment beside or above them; a name counts once a module."""

    def find(module: str, body: str):
        seen, above = set(), ""
        for line in body.split("\n"):
            note = re.search(r"//\s*(.*)", line)
            code = line[: note.start()] if note else line
            m = re.search(r"\b(input|output|inout)\b\s*(?:wire|reg|logic)?\s*(?:signed)?\s*(\[[^\]]+\])?\s*([^;)]*)", code)
            if m:
                for name in re.findall(IDENT, re.sub(r"\[[^\]]*\]", "", m[3])):
                    if name not in RESERVED and name not in seen:
                        seen.add(name)
                        yield {"module": module, "name": name, "direction": m[1], "width_expr": m[2] or "", "width": _width(m[2]), "description": (note[1].strip() if note else above)}
            above = note[1].strip() if note and not code.strip() else ""

    return _each(df, find, "module string, name string, direction string, width_expr string, width int, description string")


def signals(df: DataFrame) -> DataFrame:
    """Declared nets and variables without their initial values; memories are left out."""

    def find(module: str, body: str):
        seen = set()
        for kind, width, rest in re.findall(r"^\s*(wire|reg|logic)\b\s*(?:signed)?\s*(\[[^\]]+\])?\s*([^;]*);", _bare(body), flags=re.M):
            for part in re.sub(r"=[^,]*", "", rest).split(","):
                m = re.fullmatch(rf"\s*({IDENT})\s*", part)
                if m and m[1] not in RESERVED and m[1] not in seen:
                    seen.add(m[1])
                    yield {"module": module, "name": m[1], "datatype": kind, "width_expr": width, "width": _width(width)}

    return _each(df, find, "module string, name string, datatype string, width_expr string, width int")


def literal(value: str) -> int | None:
    """Value of a number such as 8'hFF, 4'b1010 or 42."""
    v = value.strip().replace("_", "")
    m = re.fullmatch(r"(?:\d+)?'[sS]?([bodhBODH])([0-9a-fA-F]+)", v)
    try:
        return int(m[2], {"b": 2, "o": 8, "d": 10, "h": 16}[m[1].lower()]) if m else int(v)
    except ValueError:
        return None


def parameters(df: DataFrame) -> DataFrame:
    """Parameters, local parameters and defines; values that are numbers are evaluated."""

    def find(module: str, body: str):
        text = _bare(body)
        for kind, rest in re.findall(r"\b(parameter|localparam)\b\s*(?:integer|signed)?\s*(?:\[[^\]]+\])?\s*([^;)]*)", text):
            for name, value in re.findall(rf"({IDENT})\s*=\s*([^,]+)", rest):
                yield {"module": module, "name": name, "kind": kind, "scope": "module", "default_value": value.strip()[:100], "value": literal(value)}
        for name, value in re.findall(rf"`define\s+({IDENT})[ \t]+([^\n]+)", text):
            yield {"module": module, "name": name, "kind": "define", "scope": "global", "default_value": value.strip()[:100], "value": literal(value)}

    return _each(df, find, "module string, name string, kind string, scope string, default_value string, value long")


def instances(df: DataFrame) -> DataFrame:
    """(module, target, instance, pins, overrides) of every instance of a module that is known.

    Candidates are found by shape; an equi-join with the known names says which are modules.
    """

    def find(module: str, body: str):
        for t, ov, name, pins in re.findall(rf"\b({IDENT})\s*(?:#\s*\(((?:[^()]|\([^()]*\))*)\)\s*)?({IDENT})\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)\s*;", _bare(body)):
            if t not in RESERVED and name not in RESERVED:
                yield {
                    "module": module, "target": t, "instance": name, "pins": [f"{p}={n.strip()}" for p, n in re.findall(rf"\.({IDENT})\s*\(([^()]*)\)", pins)],
                    "overrides": [f"{p}={v.strip()}" for p, v in re.findall(rf"\.({IDENT})\s*\(([^()]*)\)", ov)],
                }

    found = _each(df, find, "module string, target string, instance string, pins array<string>, overrides array<string>")
    return found.join(df.select(F.col("module").alias("target")).distinct(), "target", "left_semi")


def depends_on(found: DataFrame) -> DataFrame:
    """(module, target, instance_count, instances): at most ten names, in order."""
    g = found.filter("module <> target").groupBy("module", "target").agg(F.count("*").alias("instance_count"), F.sort_array(F.collect_set("instance")).alias("_n"))
    return g.select("module", "target", "instance_count", F.slice("_n", 1, 10).alias("instances"))


def wired(found: DataFrame, skip: tuple[str, ...] = ("clk", "rst", "reset"), low: int = 2, high: int = 20) -> DataFrame:
    """Unordered pairs of pins on one net of a module; nets with few or very many pins don't tell anything."""
    p = found.select("module", "instance", F.explode("pins").alias("_p")).select("module", F.concat_ws(".", "instance", F.split_part("_p", F.lit("="), F.lit(1))).alias("pin"), F.split_part("_p", F.lit("="), F.lit(2)).alias("net"))
    p = p.filter((F.length("net") > 0) & ~F.lower("net").isin(*skip)).distinct()
    n = p.groupBy("module", "net").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))
    p = p.join(n, ["module", "net"])
    return p.join(p.select("module", "net", F.col("pin").alias("other")), ["module", "net"]).filter("pin < other").select("module", "net", "pin", "other")


def summary(body: Column) -> Column:
    """What a module's header says about it, else its first comment."""
    said = [F.regexp_extract(body, rf"(?im)//\s*{k}\s*:?\s*(.+)$", 1) for k in ("Description", "Function", "Purpose")]
    first = F.regexp_extract(body, r"(?m)//\s*(\w.*)$", 1)
    return F.coalesce(*[F.when(F.length(s) > 0, F.trim(s)) for s in [*said, first]])


def grade(n: int) -> str:
    """Of a number of statements or operators."""
    return "Simple" if n <= 3 else "Moderate" if n <= 10 else "Complex"


def always_blocks(df: DataFrame) -> DataFrame:
    """Always blocks by position: sensitivity, clock, reset, kind, statements, complexity."""

    def find(module: str, body: str):
        text = _bare(body)
        for i, m in enumerate(re.finditer(r"\balways(?:_ff|_comb|_latch)?\b\s*(?:@\s*(\*|\([^)]*\)))?\s*", text)):
            sens = (m[1] or "*").strip("() ")
            last = "end" if text.startswith("begin", m.end()) else ";"
            stop = text.find(last, m.end())
            block = text[m.end() : len(text) if stop < 0 else stop + len(last)]
            edges = re.findall(rf"(posedge|negedge)\s+({IDENT})", sens, re.I)
            clock = edges[0][1] if edges else None
            reset = next((n for _, n in edges if re.match("rst|reset", n, re.I)), None)
            n = block.count(";")
            if "begin" in block:
                n = max(1, n - 1)
            yield {
                "module": module, "name": f"always_{i}", "sensitivity": sens, "clock": clock, "reset": reset, "block_type": "sequential" if edges else "combinational",
                "statement_count": n, "complexity": grade(n),
            }

    return _each(df, find, "module string, name string, sensitivity string, clock string, reset string, block_type string, statement_count int, complexity string")


def assigns(df: DataFrame) -> DataFrame:
    """Continuous assignments with what they drive and read, and operators + 2 parentheses + 3 conditionals."""

    def find(module: str, body: str):
        for i, (lhs, rhs) in enumerate(re.findall(r"\bassign\s+([^=;]+?)\s*=\s*([^;]+);", _bare(body))):
            bare = re.sub(r"\d*'[sS]?[bodhBODH][0-9a-fA-F_xXzZ]+", " ", rhs)
            reads = sorted({w for w in re.findall(IDENT, bare) if w not in RESERVED})
            score = len(re.findall(r"[&|^~+\-*/<>=!]", rhs)) + 2 * rhs.count("(") + 3 * rhs.count("?")
            target = re.search(IDENT, lhs)
            yield {"module": module, "name": f"assign_{i}", "target": target[0] if target else lhs, "expression": " ".join(rhs.split()), "reads": reads, "score": score, "complexity": grade(score)}

    return _each(df, find, "module string, name string, target string, expression string, reads array<string>, score int, complexity string")


def assertions(df: DataFrame) -> DataFrame:
    """Display checks, MUST and SHALL comments, synthesis-off regions and debug branches."""

    def find(module: str, body: str):
        out = []
        for m in re.finditer(r'\$(display|error|warning|fatal)\s*\(\s*"([^"]*)"', body):
            sev = m[1] if m[1] != "display" else ("error" if re.search("error", m[2], re.I) else "warning" if re.search("warn", m[2], re.I) else "info")
            out.append((m.start(), "display_check", sev, m[2]))
        out += [(m.start(), "constraint", "info", m[1].strip()) for m in re.finditer(r"//\s*(.*\b(?:MUST|SHALL)\b.*)", body)]
        out += [(m.start(), "synthesis_pragma", "info", " ".join(m[1].split())[:200]) for m in re.finditer(r"translate_off(.*?)(?://|/\*)\s*(?:synopsys|synthesis)?\s*translate_on", body, re.S)]
        out += [(m.start(), "debug_block", "info", " ".join(m[1].split())[:200]) for m in re.finditer(r"`ifdef\s+\w*DEBUG\w*(.*?)`endif", body, re.S)]
        for i, (at, kind, sev, text) in enumerate(sorted(out)):
            yield {"module": module, "name": f"assertion_{i}", "kind": kind, "severity": sev, "description": text, "line_number": body.count("\n", 0, at) + 1}

    return _each(df, find, "module string, name string, kind string, severity string, description string, line_number int")


def functions(df: DataFrame) -> DataFrame:
    """Functions: width of the result, inputs, calls of others, lines, control flow."""

    def find(module: str, body: str):
        found = re.findall(rf"\bfunction\b\s*(?:automatic)?\s*(\[[^\]]+\])?\s*({IDENT})\s*[;(](.*?)\bendfunction\b", body, flags=re.S)
        names = {n for _, n, _ in found}
        for width, name, text in found:
            ins = [n for d in re.findall(r"\binput\b\s*(?:\[[^\]]+\])?\s*([^;)]*)", text) for n in re.findall(IDENT, d) if n not in RESERVED]
            calls = sorted({c for c in re.findall(rf"({IDENT})\s*\(", text) if c in names and c != name})
            yield {"module": module, "name": name, "return_width": _width(width), "inputs": ins, "calls": calls, "lines_of_code": sum(bool(x.strip()) for x in text.split("\n")), "complexity": 1 + len(re.findall(r"\b(?:if|case[xz]?|for|while)\b|\?", text))}

    return _each(df, find, "module string, name string, return_width int, inputs array<string>, calls array<string>, lines_of_code int, complexity int")


def calls(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(module, chunk, function): functions called in a chunk of the same module, by tokens before parentheses."""
    t = chunks.select("module", "chunk", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(rf"({IDENT})\s*\("), F.lit(1)))).alias("function"))
    return t.join(known.select("module", F.col("name").alias("function")).distinct(), ["module", "function"])


def encoding_kind(values: list[int]) -> str:
    if not values:
        return "unknown"
    if all(v > 0 and v & (v - 1) == 0 for v in values) and len(values) > 2:
        return "one_hot"
    if sorted(values) == list(range(len(values))):
        gray = all(bin(a ^ b).count("1") == 1 for a, b in zip(values, values[1:]))
        return "gray" if gray and len(values) > 2 else "binary"
    return "custom"


def state_machines(df: DataFrame) -> DataFrame:
    """Transitions of state machines: (module, register, state, next_state, condition), and encodings.

    A register is a state register if a case statement on it assigns it, or its next-value twin, constants.
    """

    def find(module: str, body: str):
        text = _bare(body)
        consts = {n: literal(v) for n, v in re.findall(rf"({IDENT})\s*=\s*(\d*'[sS]?[bodhBODH][0-9a-fA-F_]+|\d+)", " ".join(re.findall(r"\b(?:parameter|localparam)\b([^;]*);", text)))}
        consts |= {n: literal(v) for n, v in re.findall(rf"`define\s+({IDENT})\s+(\d*'[sS]?[bodhBODH][0-9a-fA-F_]+|\d+)", text)}
        seen = set()
        for reg, cases in re.findall(rf"\bcase[xz]?\s*\(\s*({IDENT})\s*\)(.*?)\bendcase\b", text, flags=re.S):
            items = list(re.finditer(rf"(?:^|[\s;])`?({IDENT})\s*:", cases))
            states = [m[1] for m in items if m[1] in consts]
            if len(states) < 2:
                continue
            values = [consts[s] for s in dict.fromkeys(states)]
            for m, nxt in zip(items, [*items[1:], None]):
                if m[1] not in consts:
                    continue
                part = cases[m.end() : nxt.start() if nxt else len(cases)]
                for a in re.finditer(rf"({IDENT})\s*<?=\s*(?:#\S+\s*)?`?({IDENT})\s*;", part):
                    if a[2] in consts and (a[1] == reg or "next" in a[1].lower() or "state" in a[1].lower()):
                        cond = re.findall(r"\bif\s*\(((?:[^()]|\([^()]*\))*)\)", part[: a.start()])
                        row = (reg, m[1], a[2], cond[-1].strip() if cond else "")
                        if row not in seen:
                            seen.add(row)
                            yield {"module": module, "register": reg, "state": m[1], "next_state": a[2], "condition": row[3], "state_code": consts[m[1]], "encoding": encoding_kind(values)}

    return _each(df, find, "module string, register string, state string, next_state string, condition string, state_code long, encoding string")


#: What a memory's name says about its kind, the first that fits: fixed values. Anything else is a Memory Array.
MEMORY_KINDS = (
    ("ram.*single|single.*ram|spram", "Single-Port RAM"),
    ("ram.*dual|dual.*ram|dpram", "Dual-Port RAM"),
    ("ram", "RAM"),
    ("rom", "ROM"),
    ("rf|regfile", "Register File"),
    ("fifo", "FIFO"),
    ("cache", "Cache"),
    ("tlb", "TLB (Translation Lookaside Buffer)"),
)


def memories(df: DataFrame, least_depth: int = 16) -> DataFrame:
    """Arrays of registers of some depth, with their kind by name."""

    def find(module: str, body: str):
        for w, name, d in re.findall(rf"\b(?:reg|logic)\b\s*(\[[^\]]+\])?\s*({IDENT})\s*(\[[^\]]+\])\s*;", _bare(body)):
            width, depth = _width(w), _width(d)
            if depth and depth >= least_depth:
                kind = next((k for p, k in MEMORY_KINDS if re.search(p, name, re.I)), "Memory Array")
                yield {"module": module, "name": name, "width": width, "depth": depth, "total_bits": (width or 0) * depth, "memory_type": kind}

    return _each(df, find, "module string, name string, width int, depth int, total_bits int, memory_type string")


def memory_accesses(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(module, chunk, memory, access): writes are indexed names on the left of an assignment, others are reads."""
    t = chunks.select("module", "chunk", "code", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(rf"({IDENT})\s*\["), F.lit(1)))).alias("memory"))
    t = t.join(known.select("module", F.col("name").alias("memory")).distinct(), ["module", "memory"])
    w = F.expr("regexp_count(code, concat('\\\\b', memory, '\\\\s*\\\\[[^\\\\]]*\\\\]\\\\s*<?=[^=]'))")
    n = F.expr("regexp_count(code, concat('\\\\b', memory, '\\\\s*\\\\['))")
    t = t.withColumn("_w", w).withColumn("_n", n)
    return t.withColumn("access", F.explode(F.filter(F.array(F.when(F.col("_w") > 0, "write"), F.when(F.col("_n") > F.col("_w"), "read")), lambda x: x.isNotNull()))).select("module", "chunk", "memory", "access")


#: Prefixes of bus ports, in the order that they are tried, and the buses' names: fixed values.
BUS_PREFIXES = {
    "iwb_": "Wishbone Instruction",
    "dwb_": "Wishbone Data",
    "wb_": "Wishbone",
    "axi_": "AXI",
    "apb_": "APB",
    "ahb_": "AHB",
    "avm_": "Avalon-MM",
    "avs_": "Avalon-ST",
    "lsu_": "Load/Store Unit",
    "spr_": "Special Purpose Register",
}


def buses(port_rows: DataFrame, prefixes: dict[str, str] = BUS_PREFIXES, least: int = 3) -> DataFrame:
    """(module, prefix, port_count, name, interface_type): ports grouped by the first prefix that fits, if there are enough."""
    first = F.coalesce(*[F.when(F.col("name").startswith(p), p) for p in prefixes])
    named = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    g = port_rows.withColumn("prefix", first).filter("prefix IS NOT NULL").groupBy("module", "prefix").agg(F.count("*").alias("port_count"))
    name = F.concat(F.upper(F.regexp_replace("prefix", "^_+|_+$", "")), F.lit(" Interface"))
    return g.filter(F.col("port_count") >= least).select("*", name.alias("name"), F.element_at(named, F.col("prefix")).alias("interface_type"))


#: Operators by pattern: fixed values; <= counts inside parentheses only, since it also assigns.
OPERATORS = (
    (r"\+", "Adder"),
    (r"\-", "Subtractor"),
    (r"\*", "Multiplier"),
    (r"\/", "Divider"),
    ("<<<", "Arithmetic Left Shifter"),
    (">>>", "Arithmetic Right Shifter"),
    ("<<", "Logical Left Shifter"),
    (">>", "Logical Right Shifter"),
    (">=", "Comparator"),
    (r"\(\s*.*?<=.*?\)", "Comparator"),
    (">", "Comparator"),
    ("<", "Comparator"),
    ("==", "Equality"),
    ("!=", "Equality"),
)


def operators(chunks: DataFrame) -> DataFrame:
    """(module, chunk, operator_type): which kinds of operators a chunk uses."""
    kinds = F.array(*[F.when(F.col("code").rlike(p), k) for p, k in OPERATORS])
    return chunks.select("module", "chunk", F.explode(F.array_distinct(F.filter(kinds, lambda x: x.isNotNull()))).alias("operator_type"))


def generate_blocks(df: DataFrame) -> DataFrame:
    """Generate blocks with their loops."""

    def find(module: str, body: str):
        for i, g in enumerate(re.findall(r"\bgenerate\b(.*?)\bendgenerate\b", _bare(body), flags=re.S)):
            loops = [f"{v}:{a.strip()}..{b.strip()}" for v, a, b in re.findall(rf"\bfor\s*\(\s*({IDENT})\s*=\s*([^;]+);\s*{IDENT}\s*<\s*([^;]+);", g)]
            yield {"module": module, "name": f"gen_{i}", "loop_count": len(loops), "loops": loops}

    return _each(df, find, "module string, name string, loop_count int, loops array<string>")


def clock_crossings(blocks: DataFrame) -> DataFrame:
    """(module, signal, from_clock, to_clock): driven under one clock and read under another.

    ``blocks``: (module, clock, code) of sequential blocks.
    """
    code = strip_comments(F.col("code"))
    d = blocks.select("module", F.col("clock").alias("from_clock"), F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(rf"({IDENT})\s*(?:\[[^\]]*\])?\s*<="), F.lit(1)))).alias("signal"))
    r = blocks.select("module", F.col("clock").alias("to_clock"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(code, rf"{IDENT}\s*(\[[^\]]*\])?\s*<=", ""), F.lit(f"({IDENT})"), F.lit(1)))).alias("signal"))
    return d.join(r, ["module", "signal"]).filter("from_clock <> to_clock").distinct()


def uses_parameter(sized: DataFrame, params: DataFrame, expr: str) -> DataFrame:
    """(module, name, parameter): parameters that a width or depth expression names."""
    t = sized.select("module", "name", F.explode(F.array_distinct(F.regexp_extract_all(expr, F.lit(f"({IDENT})"), F.lit(1)))).alias("parameter"))
    return t.join(params.select("module", F.col("name").alias("parameter")).distinct(), ["module", "parameter"])


def resolve_names(wanted: DataFrame, by_kind: list[tuple[str, DataFrame]]) -> DataFrame:
    """(module, name, kind): the first kind in order that declares the name in the module; else ``unresolved``."""
    d = wanted.select("module", "name").distinct()
    kinds = []
    for i, (kind, decl) in enumerate(by_kind):
        d = d.join(decl.select("module", "name").distinct().withColumn(f"_k{i}", F.lit(kind)), ["module", "name"], "left")
        kinds.append(F.col(f"_k{i}"))
    return d.select("module", "name", F.coalesce(*kinds, F.lit("unresolved")).alias("kind"))


# --- documents and language model output ----------------------------------------------------------

#: Types of relations: fixed values.
RELATION_TYPES = (
    "IMPLEMENTS", "INCLUDES", "CONNECTS_TO", "CONFIGURES", "CONTROLS", "DRIVES", "READS_FROM",
    "DEPENDS_ON", "SUPERSEDES", "COMPATIBLE_WITH", "TESTED_BY", "DOCUMENTS", "RELATED_TO",
)
#: Other labels and the types that they stand for: fixed values.
RELATIONS = {
    "uses": "INCLUDES",
    "has": "INCLUDES",
    "contains": "INCLUDES",
    "is_part_of": "INCLUDES",
    "is_subcomponent_of": "INCLUDES",
    "has_feature": "INCLUDES",
    "is_component_of": "INCLUDES",
    "connects": "CONNECTS_TO",
    "is_connected_to": "CONNECTS_TO",
    "is_interface_of": "CONNECTS_TO",
    "interfaces_with": "CONNECTS_TO",
    "implements_interface": "IMPLEMENTS",
    "is_implemented_by": "IMPLEMENTS",
    "requires": "DEPENDS_ON",
    "needs": "DEPENDS_ON",
    "verifies": "TESTED_BY",
    "is_verified_by": "TESTED_BY",
    "describes": "DOCUMENTS",
    "is_described_by": "DOCUMENTS",
    "documents": "DOCUMENTS",
    "associated_with": "RELATED_TO",
    "relates_to": "RELATED_TO",
    "is_related_to": "RELATED_TO",
    "interacts_with": "RELATED_TO",
}


def relation_label(label: Column, allowed: tuple[str, ...] = RELATION_TYPES) -> Column:
    """A type that is allowed, in any spelling; else what the label stands for, or RELATED_TO."""
    m = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    typed = F.regexp_replace(F.upper(label), "[ -]", "_")
    return F.when(typed.isin(*allowed), typed).otherwise(F.coalesce(F.try_element_at(m, F.replace(F.lower(label), F.lit(" "), F.lit("_"))), F.lit("RELATED_TO")))


OUTPUT = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,target:string,type:string>>>"


def parse_output(text: Column) -> Column:
    """Entities and relations from a model's answer: fences removed, broken JSON gives null."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.from_json(bare, OUTPUT, {"mode": "PERMISSIVE"})


def entities_and_relations(answers: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, name, type, description), and relations of which both ends are entities of the same answer."""
    d = answers.select(key, parse_output(F.col(text)).alias("o"))
    e = d.select(key, F.explode("o.entities").alias("e")).select(key, "e.name", "e.type", F.left("e.description", F.lit(300)).alias("description")).filter(F.length(F.trim("name")) > 0)
    r = d.select(key, F.explode("o.relations").alias("r")).select(key, "r.source", "r.target", relation_label(F.col("r.type")).alias("type"))
    n = e.select(key, F.lower("name").alias("n")).distinct()
    r = r.withColumn("n", F.lower("source")).join(n, [key, "n"], "left_semi").withColumn("n", F.lower("target")).join(n, [key, "n"], "left_semi").drop("n")
    return e, r


def rule_entities(chunks: DataFrame, key: str, text: str, kinds: dict[str, str]) -> DataFrame:
    """(key, name, type) by keywords: the deterministic stand-in for extraction by a language model."""
    found = F.array(*[F.when(F.col(text).rlike(rf"(?i)\b{re.escape(w)}\b"), F.struct(F.lit(w).alias("name"), F.lit(t).alias("type"))) for w, t in kinds.items()])
    return chunks.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select(key, "e.name", "e.type")
