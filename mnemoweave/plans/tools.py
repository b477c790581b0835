"""Tool calls of an agent: reading them from a model's answer, and running them against a graph."""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.operators import aggregates, lookups, relations
from mnemoweave.plans import agent, retrieval
from mnemoweave.state import GraphState

RESULT_CHARS = 5000
ROUNDS = 5
DEFAULT_WINDOW = 100_000


class Call(NamedTuple):
    tool: str
    args: list


class Answer(NamedTuple):
    thoughts: str | None
    calls: list[Call]
    text: str


def context_budget(model: str, windows: dict[str, int], share: float = 0.60, default: int = DEFAULT_WINDOW) -> int:
    """A share of a model's window: of its own name, else of the longest known beginning of it."""
    known = max((n for n in windows if model.startswith(n)), key=len, default=None)
    return int(windows.get(model, windows[known] if known else default) * share)


def call_of(text: str) -> Call | None:
    """``name(literals)``; where they are not literals, what stands in quotes."""
    opened = text.find("(")
    name, closed = text[:opened].strip(), text.rfind(")")
    if opened < 1 or closed < opened or not re.fullmatch(r"\w+", name):
        return None
    inside = text[opened + 1 : closed].strip()
    try:
        return Call(name, ast.literal_eval(f"[{inside}]"))
    except (ValueError, SyntaxError):
        found = [a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", inside)]
        return Call(name, found) if found else None


def read_answer(text: str, tools: tuple[str, ...]) -> Answer:
    """Thoughts, tool calls and plain text; an open block runs to the end, and without blocks known calls are looked for."""
    tidy = re.sub(r"<\s*(/?)\s*(think|action)\s*>", r"<\1\2>", text)
    blocks = re.findall(r"<(think|action)>(.*?)(?:</\1>|\Z)", tidy, re.DOTALL)
    thoughts = next((b.strip() for k, b in blocks if k == "think"), None)
    calls = [c for k, b in blocks if k == "action" and (c := call_of(b.strip()))]
    if not calls and tools:
        calls = [c for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, tools))})\s*\(.*?\)", tidy, re.DOTALL) if (c := call_of(m[0]))]
    return Answer(thoughts, calls, re.sub(r"<(think|action)>.*?(?:</\1>|\Z)", "", tidy, flags=re.DOTALL).strip())


class Tools:
    """The tools an agent may call, as functions from a graph and its ranks to rows."""

    def __init__(self, state: GraphState, ranks: DataFrame):
        self.state, self.ranks = state, ranks
        self.known = {
            "graph_status": lambda: aggregates.statistics(state),
            "entity_profile": lambda ref: agent.briefs(state, lookups.resolve(state, ref), ranks),
            "entity_mentions": lambda ref, n=20: agent.mentions(state, self._id(ref), n),
            "cooccurrences": lambda ref: relations.neighbour_counts(state, self._id(ref)).orderBy(F.desc("count"), "id").limit(20),
            "evidence": lambda a, b: relations.evidence(state, self._id(a), self._id(b)),
            "timeline": lambda ref, n=30: agent.timeline(state, self._id(ref), n),
            "search_entities": lambda text, n=20: lookups.search_entities(state, text, n),
            "knowledge_map": lambda n=30: retrieval.knowledge_map(state, ranks, n),
        }

    def _id(self, reference: str) -> str:
        row = lookups.resolve(self.state, reference).first()
        return row["id"] if row else ""

    def run(self, call: Call) -> str:
        """The rows as text, cut to what a model is shown; an error as text."""
        if call.tool not in self.known:
            return f"unknown tool {call.tool}"
        try:
            rows = self.known[call.tool](*call.args)
        except TypeError as e:
            return f"wrong arguments: {e}"
        out, chars = [], 0
        for r in rows.toLocalIterator():  # no more than are shown
            out.append(", ".join(f"{k}={v}" for k, v in r.asDict().items()))
            chars += len(out[-1]) + 1
            if chars > RESULT_CHARS:
                break
        return "\n".join(out)[:RESULT_CHARS]


def converse(ask, tools: Tools, question: str, rounds: int = ROUNDS) -> str:
    """Ask a model, run the calls it makes, and ask again with their results; at most ``rounds`` times."""
    messages = [{"role": "user", "content": question}]
    answer = Answer(None, [], "")
    for _ in range(rounds):
        text = ask(messages)
        answer = read_answer(text, tuple(tools.known))
        if not answer.calls:
            break
        messages += [{"role": "assistant", "content": text}, {"role": "user", "content": "\n\n".join(f"{c.tool}: {tools.run(c)}" for c in answer.calls)}]
    return answer.text
