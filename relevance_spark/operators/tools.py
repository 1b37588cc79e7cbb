"""Tools for language-model agents: described functions, checked arguments, and ready ones over searches, memory and routes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.operators.service import Corpus, Memory, Router


class ToolError(ValueError):
    """What an agent did wrong, in words for it."""


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    properties: dict
    required: tuple
    run: Callable

    @property
    def schema(self) -> dict:
        return {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}


def _is(kind: str | None, value) -> bool:
    if isinstance(value, bool):
        return kind in (None, "boolean")
    types = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
    return kind is None or isinstance(value, types[kind])


def checked(tool: Tool, given) -> dict:
    """Arguments that the tool may be called with; the first fault is named."""
    if isinstance(given, str):
        try:
            given = json.loads(given) if given.strip() else {}
        except json.JSONDecodeError as e:
            raise ToolError(f"{tool.name}: the arguments are not JSON ({e.msg})") from e
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise ToolError(f"{tool.name}: the arguments are no object")
    faults = [f"{n!r} is missing" for n in tool.required if n not in given] + [f"{n!r} is unknown" for n in sorted(set(given) - set(tool.properties))]
    for name, value in given.items():
        rule = tool.properties.get(name, {})
        if not _is(rule.get("type"), value):
            faults.append(f"{name!r} is no {rule['type']}")
            continue
        tests = {"minimum": lambda x, r: x >= r, "maximum": lambda x, r: x <= r, "maxLength": lambda x, r: len(x) <= r, "enum": lambda x, r: x in r}
        faults += [f"{name!r} breaks {t} {rule[t]}" for t, ok in tests.items() if t in rule and not ok(value, rule[t])]
    if faults:
        raise ToolError(f"{tool.name}: {faults[0]}")
    return given


class ToolKit:
    """Tools by name, each name once."""

    def __init__(self, *tools: Tool):
        self.tools: dict[str, Tool] = {}
        for t in tools:
            self.add(t)

    def add(self, tool: Tool) -> ToolKit:
        if tool.name in self.tools:
            raise ValueError(f"there is a tool {tool.name!r} already")
        self.tools[tool.name] = tool
        return self

    def __add__(self, other: ToolKit) -> ToolKit:
        return ToolKit(*self.tools.values(), *other.tools.values())

    def __len__(self) -> int:
        return len(self.tools)

    def names(self) -> list[str]:
        return [*self.tools]

    def described(self, style: str = "anthropic") -> list[dict]:
        """The two usual shapes of tool lists in requests."""
        if style == "anthropic":
            return [{"name": t.name, "description": t.description, "input_schema": t.schema} for t in self.tools.values()]
        if style == "openai":
            return [{"type": "function", "function": {"name": t.name, "description": t.description, "parameters": t.schema}} for t in self.tools.values()]
        raise ValueError(f"unknown style {style!r}")

    def call(self, name: str, arguments=None):
        if name not in self.tools:
            raise ToolError(f"there is no tool {name!r}; there are {self.names()}")
        tool = self.tools[name]
        return tool.run(**checked(tool, arguments))


def _text(most: int) -> dict:
    return {"type": "string", "maxLength": most}


def _whole(most: int) -> dict:
    return {"type": "integer", "minimum": 1, "maximum": most}


def seen_by_agents(hits: DataFrame) -> list[dict]:
    """Rows of a ranking for an agent: id, score at four decimals, text, and other columns unless their name begins with _."""
    hidden = {"query_id", "rank", "vec", "id", "score", "text", "retrieval_score"}
    rest = [c for c in hits.columns if c not in hidden and not c.startswith("_")]
    rows = hits.orderBy("rank").select(F.col("id").cast("string").alias("id"), F.round("score", 4).alias("score"), "text", *rest).collect()
    return [{"id": r["id"], "score": r.score, "text": r.text, "metadata": {c: r[c] for c in rest}} for r in rows]


def search_tools(corpus: Corpus, prefix: str = "knowledge", most: int = 20, writable: bool = False, longest: int = 20_000) -> ToolKit:
    """``<prefix>_search``, and ``<prefix>_add`` where writing is allowed."""
    find = Tool(f"{prefix}_search", "Find the passages that fit a question best, with their scores.", {"query": _text(longest), "k": _whole(most)}, ("query",), lambda query, k=5: seen_by_agents(corpus.search([query], k)))
    kit = ToolKit(find)
    if writable:
        kit.add(Tool(f"{prefix}_add", "Add a passage that later searches can find.", {"text": _text(longest), "metadata": {"type": "object"}}, ("text",), lambda text, metadata=None: {"id": corpus.add([text], [metadata or {}])[0]}))
    return kit


def memory_tools(memory: Memory, prefix: str = "memory", most: int = 20, longest: int = 5_000) -> ToolKit:
    """``<prefix>_remember`` and ``<prefix>_recall``."""
    keep = Tool(f"{prefix}_remember", "Keep a fact or an observation.", {"text": _text(longest), "tags": {"type": "object"}}, ("text",), lambda text, tags=None: {"id": memory.remember(text, tags)})
    find = Tool(f"{prefix}_recall", "Find what was kept about something.", {"query": _text(longest), "k": _whole(most)}, ("query",), lambda query, k=5: seen_by_agents(memory.recall(query, k)))
    return ToolKit(keep, find)


def route_tools(router: Router, name: str = "route_request", longest: int = 5_000) -> ToolKit:
    """One tool that names the route of a request, and the runners-up."""

    def run(request: str, k: int = 3) -> dict:
        ranked = router.shortlist(request, k)
        return {"match": router.route(request), "candidates": [{"route": r, "score": round(s, 4)} for r, s in ranked]}

    return ToolKit(Tool(name, "Find what handles a request best.", {"request": _text(longest), "k": _whole(20)}, ("request",), run))
