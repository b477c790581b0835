"""Labels and tags of chunks from a language model: batches, single calls where a batch is rejected, a breaker for each document."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.operators.lookups import not_filler

CLASSIFY_BATCH, TAG_BATCH = 10, 5
BREAKER_LEAST, BREAKER_SHARE = 2, 0.5
TAG_RETRIES = 1
OUTPUT_ROWS = 500  # chunks whose tags a task holds as Python objects
DEFAULT_LABEL = "background"
#: Fixed value: how sources of conversations begin.
CONVERSATION = "claude-session://"
Tags = list[tuple[str, str]]

#: Words that speak for a label, for the rule-based client.
CUES = {
    "decision": ("decided", "decision", "agreed", "approved"), "action_item": ("todo", "action item", "will do", "needs to", "follow up"),
    "status_update": ("status", "progress", "completed", "shipped"), "preference": ("prefer", "favorite", "rather"), "filler": ("hello everyone", "thanks all", "good morning"),
}


class Client(Protocol):
    """A language model.  A call with several texts may fail as a whole (None, an error, or answers of another number); one
    answer of ``tag`` may be None.  ``for_source``, if there is one, gives the client for conversations or other sources."""

    def classify(self, texts: list[str]) -> list[str] | None: ...
    def tag(self, texts: list[str]) -> list[Tags | None] | None: ...


class RuleClient:
    """Labels by cue words and tags by capitalised phrases: deterministic and offline."""

    def classify(self, texts: list[str]) -> list[str]:
        return [next((label for label, cues in CUES.items() if any(c in t.lower() for c in cues)), "discussion") for t in texts]

    def tag(self, texts: list[str]) -> list[Tags | None]:
        return [[(m, "concept") for m in dict.fromkeys(re.findall(r"\b[A-Z][\w-]+(?: [A-Z][\w-]+)*\b", t)) if len(m) > 2] for t in texts]


class DegradedClient(RuleClient):
    """A client whose answers fail or come malformed now and then, the same ones in every run.

    The defaults are fixed values of the evaluation.
    """

    def __init__(self, failure: float = 0.10, malformed: float = 0.15, seed: int = 42):
        self.failure, self.malformed, self.seed = failure, malformed, seed

    def tag(self, texts: list[str]) -> list[Tags | None]:
        import random

        out = []
        for t, tags in zip(texts, super().tag(texts)):
            x = random.Random(f"{self.seed}:{t}").random()
            out.append(None if x < self.failure else [] if x < self.failure + self.malformed else tags)
        return out


class PromptClient:
    """Asks ``chat`` (prompt -> answer) with templates by name: ``classify``, ``classify_batch``, ``tag``, ``tag_batch``.

    For conversations ``<task>_conversation`` and ``<task>_conversation_batch`` are taken where there are such.  A template
    names ``{chunk_text}``, or ``{chunks}`` for several.
    """

    def __init__(self, chat: Callable[[str], str], templates: dict[str, str], labels: tuple[str, ...], conversation: bool = False):
        self.chat, self.templates, self.labels, self.conversation = chat, templates, labels, conversation

    def for_source(self, conversation: bool) -> PromptClient:
        return PromptClient(self.chat, self.templates, self.labels, conversation)

    def _ask(self, task: str, texts: list[str]) -> str:
        batch = "_batch" if len(texts) > 1 else ""
        names = [f"{task}_conversation{batch}"] if self.conversation else []
        template = next(self.templates[n] for n in [*names, task + batch] if n in self.templates)
        if not batch:
            return self.chat(template.replace("{chunk_text}", texts[0]))
        return self.chat(template.replace("{chunks}", "\n\n".join(f"---CHUNK {i}---\n{t}" for i, t in enumerate(texts, 1))))

    def classify(self, texts: list[str]) -> list[str] | None:
        answer = self._ask("classify", texts)
        if len(texts) == 1:
            word = next(iter(re.findall(r"[a-z_]+", answer.lower())), "")
            return [word if word in self.labels else DEFAULT_LABEL]
        found = [w for w in (next(iter(re.findall(r"[a-z_]+", re.sub(r"^\s*\d+[.):]?\s*", "", line.lower()))), "") for line in answer.splitlines()) if w in self.labels]
        return found[: len(texts)] if len(found) >= len(texts) else None

    def tag(self, texts: list[str]) -> list[Tags | None] | None:
        answer = self._ask("tag", texts)
        if len(texts) == 1:
            return [_tags(_read(answer, "[", "]"))]
        by_number = _read(answer, "{", "}")
        if not isinstance(by_number, dict) or not any(str(i) in by_number for i in range(1, len(texts) + 1)):
            return None
        return [_tags(by_number.get(str(i))) for i in range(1, len(texts) + 1)]


def _read(answer: str, opening: str, closing: str) -> object:
    """The JSON between the outermost brackets, also with single quotes or commas too many; None if it cannot be read."""
    text = answer[answer.find(opening) : answer.rfind(closing) + 1]
    for form in (text, re.sub(r",\s*([\]}])", r"\1", text.replace("'", '"'))):
        with suppress(ValueError):
            return json.loads(form)
    return None


def _tags(rows: object) -> Tags | None:
    if not isinstance(rows, list):
        return None
    named = [{str(k).lower(): v for k, v in r.items()} for r in rows if isinstance(r, dict)]
    return [(str(r["name"]).strip(), str(r.get("type") or r.get("entity_type") or "concept").lower()) for r in named if str(r.get("name") or "").strip()]


def _answers(call: Callable[[list[str]], list | None], texts: list[str]) -> list | None:
    """The answers of a call, or None if it fails as a whole."""
    try:
        found = call(texts)
    except Exception:  # noqa: BLE001  a model's errors are of any kind; callers ask again or count a failure
        return None
    return found if found is not None and len(found) == len(texts) else None


def _for(client: Client, conversation: bool) -> Client:
    return client.for_source(conversation) if hasattr(client, "for_source") else client


def classified(chunks: DataFrame, client: Client | None = None, batch: int = CLASSIFY_BATCH) -> DataFrame:
    """``chunks`` with ``label``, without filler.

    A batch of texts of one kind of source that fails is asked text by text; a text that fails alone is background.
    """
    client = client or RuleClient()

    @F.pandas_udf("string")
    def label(texts: pd.Series, sources: pd.Series) -> pd.Series:
        out = pd.Series(DEFAULT_LABEL, index=texts.index, dtype="object")
        spoken = sources.fillna("").str.startswith(CONVERSATION)
        for conversation in (False, True):
            mine, ask = texts[spoken == conversation].fillna(""), _for(client, conversation)
            for at in range(0, len(mine), batch):
                part = mine.iloc[at : at + batch]
                found = _answers(ask.classify, part.tolist())
                if found is None:
                    found = [(_answers(ask.classify, [t]) or [DEFAULT_LABEL])[0] for t in part]
                out.loc[part.index] = found
        return out

    return chunks.withColumn("label", label("text", "source_document")).where(not_filler(F.col("label")))


class _Breaker:
    """Tags the chunks of one document, some at a time, until over half of more than two have failed."""

    def __init__(self, client: Client, retries: int):
        self.client, self.retries = client, retries
        self.done = self.failed = 0

    @property
    def open(self) -> bool:
        return self.done > BREAKER_LEAST and self.failed / self.done > BREAKER_SHARE

    def _alone(self, text: str) -> Tags | None:
        for _ in range(1 + self.retries):
            if (found := _answers(self.client.tag, [text])) and found[0] is not None:
                return found[0]
        return None

    def tag(self, texts: list[str]) -> list[Tags | None]:
        found = _answers(self.client.tag, texts) if len(texts) > 1 else None
        if found is None:
            found = [self._alone(t) for t in texts]
        self.done += len(texts)
        self.failed += sum(x is None for x in found)
        return found


_TAGGED = "id string, source_document string, text string, failed boolean, tags array<struct<name:string,entity_type:string>>"


def tagged(chunks: DataFrame, client: Client | None = None, retries: int = TAG_RETRIES) -> DataFrame:
    """(id, source_document, text, failed, tags) of chunks (id, source_document, position, text), as far as each document comes.

    Chunks are sorted by document and position and pass one after the other; a task holds an Arrow batch and the few
    chunks of the next call, however long a document is.  Several chunks are tagged in one call; if it fails, each is
    asked alone, with ``retries``.  After each call a document is given up once over half of more than two chunks failed:
    its further chunks give no row.
    """
    client = client or RuleClient()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, breaker, waiting = None, None, []

        def call() -> list[tuple]:
            rows = list(waiting)
            waiting.clear()
            found = breaker.tag([r.text or "" for r in rows]) if rows and not breaker.open else []
            return [(r.id, r.source_document, r.text, t is None, [{"name": n, "entity_type": k} for n, k in t or []]) for r, t in zip(rows, found)]

        for pdf in (whole.iloc[k : k + OUTPUT_ROWS] for whole in batches for k in range(0, len(whole), OUTPUT_ROWS)):
            out = []
            for row in pdf.itertuples(index=False):
                if breaker is None or row.source_document != document:
                    out += call()
                    document = row.source_document
                    breaker = _Breaker(_for(client, (document or "").startswith(CONVERSATION)), retries)
                if not breaker.open:
                    waiting.append(row)
                    if len(waiting) == TAG_BATCH:
                        out += call()
            yield pd.DataFrame(out, columns=["id", "source_document", "text", "failed", "tags"])
        yield pd.DataFrame(call(), columns=["id", "source_document", "text", "failed", "tags"])

    rows = chunks.select("id", "source_document", "position", "text")
    return rows.repartition("source_document").sortWithinPartitions("source_document", "position", "id").select("id", "source_document", "text").mapInPandas(run, _TAGGED)
