"""What comes from hooks and plug-ins: messages of events, overflow files, archived transcripts."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoweave.plans.parsing import stripped

_MESSAGE = "array<struct<role:string,type:string,text:string,content:string,body:string>>"


def _body(m: Column) -> Column:
    """A message's text: its text, its content as a string or as parts joined by line, or its body."""
    parts = F.from_json(m["content"], "array<string>")
    words = F.transform(parts, lambda p: F.when(F.ltrim(p).startswith("{"), F.get_json_object(p, "$.text")).otherwise(p))
    joined = F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), "\n")
    return F.coalesce(m["text"], F.when(F.ltrim(m["content"]).startswith("[") & parts.isNotNull(), joined).otherwise(m["content"]), m["body"])


def messages(event: Column) -> Column:
    """array<struct<role, text>> of an event in any of its four shapes; blank messages are left out."""
    found = F.from_json(F.coalesce(F.get_json_object(event, "$.conversation.messages"), F.get_json_object(event, "$.messages"), F.get_json_object(event, "$.transcript")), _MESSAGE)
    output = F.get_json_object(event, "$.output")
    rows = F.transform(found, lambda m: F.struct(F.coalesce(m["role"], m["type"], F.lit("unknown")).alias("role"), _body(m).alias("text")))
    last = F.when(F.trim(output) != "", F.array(F.struct(F.lit("assistant").alias("role"), output.alias("text"))))
    kept = F.filter(F.coalesce(rows, last), lambda m: F.coalesce(stripped(m["text"]) != "", F.lit(False)))
    return F.coalesce(kept, F.array().cast("array<struct<role:string,text:string>>"))


def transcript(found: Column) -> Column:
    """``User: ...`` and ``Assistant: ...`` paragraphs of messages."""
    label = lambda m: F.when(m["role"] == "user", "User").when(m["role"] == "assistant", "Assistant").otherwise(m["role"])
    return F.array_join(F.transform(found, lambda m: F.concat(label(m), F.lit(": "), m["text"])), "\n\n")


def routed(overflow: DataFrame) -> DataFrame:
    """Overflow rows with ``status``: processed if valid, else failed; write it with ``partitionBy("status")``."""
    return overflow.withColumn("status", F.when(F.col("valid"), "processed").otherwise("failed"))


def write_overflow(folder: str, source_id: str, text: str, captured_at: int, category: str = "Episodic", project: str | None = None) -> str:
    """One overflow file, written aside and renamed; named by its time and a hash, so that a repeat replaces itself."""
    name = f"{captured_at}-{hashlib.sha256(f'{source_id}\n{text}'.encode()).hexdigest()[:16]}.json"
    target = Path(folder, name)
    aside = target.with_suffix(".tmp")
    aside.write_text(json.dumps({"version": 1, "source_id": source_id, "text": text, "category": category, "project": project, "captured_at": captured_at}))
    os.replace(aside, target)
    return str(target)


def archive_transcript(path: str, folder: str, session_id: str) -> str:
    """A copy of a session's file under its id, in place of an older one."""
    target = Path(folder, f"{session_id}.jsonl")
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(path, target)
    return str(target)
