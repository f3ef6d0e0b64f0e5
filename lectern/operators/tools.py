"""Tools a model may call: what arguments they take, and which calls don't fit. Conditions on VARIANT values, in the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import agent

TEXT = {"type": "string"}


def whole(least: int, most: int) -> dict:
    return {"type": "integer", "minimum": least, "maximum": most}


def listed(items: dict, least: int = 0) -> dict:
    return {"type": "array", "items": items, "minItems": least}


def fields(optional: tuple[str, ...] = (), **of: dict) -> dict:
    """An object of just these fields; a null counts as an optional field left out."""
    return {"type": "object", "properties": of, "required": [k for k in of if k not in optional], "additionalProperties": False}


def choice(*of: str) -> dict:
    return {"type": "string", "enum": list(of)}


# Names and parameters of the tools.
TOOLS = {
    "search_book": fields(("top_k", "scope"), query=TEXT, top_k=whole(1, 20), scope=TEXT),
    "read_section": fields(section_id=TEXT),
    "get_exam_blueprint": fields(("subject", "top_n"), subject=TEXT, top_n=whole(1, 50)),
    "make_flowchart": fields(title=TEXT, steps=listed(fields(id=TEXT, label=TEXT), 2), edges=listed(fields(("label",), source=TEXT, target=TEXT, label=TEXT), 1)),
    "make_table": fields(title=TEXT, columns=listed(TEXT, 2), rows=listed(listed(TEXT), 1)),
    "make_mindmap": fields(root=TEXT, branches=listed(fields(("children",), label=TEXT, children=listed(TEXT)), 2)),
    "make_timeline": fields(title=TEXT, events=listed(fields(when=TEXT, what=TEXT), 2)),
    "make_formula_sheet": fields(title=TEXT, formulas=listed(fields(name=TEXT, expression=TEXT, variables=TEXT), 1)),
    "make_glossary": fields(terms=listed(fields(term=TEXT, definition=TEXT), 1)),
    "generate_questions": fields(topic=TEXT, count=whole(1, 20), marks=whole(1, 25), question_type=choice("mcq", "short", "long", "numerical", "diagram", "case_study")),
    "grade_answer": fields(question=TEXT, student_answer=TEXT, max_marks=whole(1, 25)),
    "calculate": fields(expression=TEXT),
    "create_flashcards": fields(("count",), topic=TEXT, count=whole(1, 50)),
    "export_notes": fields(("topic",), format=choice("markdown", "html", "pdf", "anki"), topic=TEXT),
}
SHOWN = 3


def schemas(names: list[str] | None = None) -> str:
    """The tools as JSON schemas, the form in which chat servers take them."""
    return json.dumps([{"type": "function", "function": {"name": n, "parameters": TOOLS[n]}} for n in (TOOLS if names is None else names)])


def _none() -> Column:
    return F.array().cast("array<string>")


def _fault(wrong: Column, path: Column, text: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.concat(path, F.lit(f": {text}")))).otherwise(_none())


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def faults(v: Column, spec: dict, path: Column) -> Column:
    """What is wrong with a VARIANT under a schema, as an array of 'place: reason'."""
    kind = agent.kind_of(v)
    if spec["type"] == "string":
        text = F.try_variant_get(v, "$", "string")
        return _fault(kind != "STRING" if "enum" not in spec else (kind != "STRING") | ~text.isin(spec["enum"]), path, "text wanted" if "enum" not in spec else "one of " + ", ".join(spec["enum"]))
    if spec["type"] == "integer":
        number = F.try_variant_get(v, "$", "double")
        fit = ~F.startswith(kind, F.lit("BOOLEAN")) & (number == F.floor(number)) & number.between(spec["minimum"], spec["maximum"])
        return _fault(~fit, path, f"a whole number from {spec['minimum']} to {spec['maximum']} wanted")
    if spec["type"] == "array":
        items = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))
        few = F.when(F.size(items) < spec["minItems"], F.array(F.concat(path, F.lit(f": at least {spec['minItems']} wanted")))).otherwise(_none())
        each = F.flatten(F.transform(items, lambda x, i: faults(x, spec["items"], _below(path, i.cast("string")))))
        return F.when(items.isNull(), F.array(F.concat(path, F.lit(": a list wanted")))).otherwise(F.concat(few, each))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    other = F.transform(F.array_except(keys, F.array(*map(F.lit, spec["properties"]))), lambda k: F.concat(_below(path, k), F.lit(": not a parameter")))
    parts = []
    for name, of in spec["properties"].items():
        x, at = F.try_variant_get(v, f"$.{name}", "variant"), _below(path, F.lit(name))
        absent = x.isNull() | (F.coalesce(F.is_variant_null(x), F.lit(False)) if name not in spec["required"] else F.lit(False))
        parts.append(F.when(absent, F.array(F.concat(at, F.lit(": missing"))) if name in spec["required"] else _none()).otherwise(faults(x, of, at)))
    return F.when(~F.startswith(kind, F.lit("OBJECT")) | kind.isNull(), F.array(F.concat(path, F.lit(": an object wanted")))).otherwise(F.concat(*parts, other))


def call_fault(name: Column, arguments: Column, among: list[str] | None = None) -> Column:
    """Why a call (name, arguments as JSON) can't be run, the first ``SHOWN`` reasons; null for one that can.

    ``among`` names the tools that the calls may be of, where that is known: conditions of others are left out of the plan.
    """
    read = F.try_parse_json(arguments)
    out = F.when(name.isNull() | ~name.isin(*TOOLS), F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("")))).when(read.isNull(), "arguments were not valid JSON")
    for tool, spec in TOOLS.items():
        if among is not None and tool not in among:
            continue
        wrong = F.slice(faults(read, spec, F.lit("")), 1, SHOWN)
        out = out.when(name == tool, F.nullif(F.array_join(wrong, "; "), F.lit("")))
    return out


@F.pandas_udf(DoubleType())
def calculated(expression: pd.Series) -> pd.Series:
    """The value of arithmetic expressions, null for those that aren't allowed or have none."""
    return expression.map(agent.calculate).astype("float64")
