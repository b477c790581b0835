"""Source trees: a walk by levels under the ignore rules of every folder, and the contents of what it finds.

Spark's own readers pass over names that begin with a dot or an underscore, so folders are listed and files are read in
tasks, through any file system that pyarrow knows by its address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.storage import materialise

RULES_FILE = ".gitignore"
FOLDERS_A_TASK = 64
_LISTED = "path string, is_folder boolean, rules array<struct<folder:string,text:string>>"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return system, path.rstrip("/")


def _segment(pattern: str) -> str:
    """A regular expression of one part of a path pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = close
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


class Rule:
    """One line of an ignore file: what it matches, whether it takes back, whether it is for folders only."""

    def __init__(self, line: str):
        self.taken_back = line.startswith("!")
        body = line[1:] if self.taken_back else line
        self.folders_only = body.endswith("/")
        parts = body.rstrip("/").split("/")
        if len(parts) == 1:
            parts = ["**", *parts]  # without a slash it holds at any depth
        elif parts[0] == "":
            parts = parts[1:]
        out = ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                out += ".+" if last else "(?:[^/]+/)*"
            else:
                out += _segment(part) + ("" if last else "/")
        self.regex = re.compile(out + r"\Z", re.DOTALL)

    def hits(self, path: str, is_folder: bool) -> bool:
        return (is_folder or not self.folders_only) and bool(self.regex.match(path))


def rules_of(text: str) -> list[Rule]:
    """The rules of an ignore file, in order; blank lines and comments are left out, trailing blanks unless escaped."""
    lines = [re.sub(r"(?<!\\)[ \t]+$", "", x) for x in text.splitlines()]
    return [Rule(x) for x in lines if x.strip("/!") and not x.startswith("#")]


def ignored(path: str, is_folder: bool, chain: list[tuple[str, list[Rule]]]) -> bool:
    """Whether the last rule that matches a path says so; ``chain`` has (folder, rules) of its folders, the outermost first."""
    for folder, rules in reversed(chain):
        for rule in reversed(rules):
            if rule.hits(path[len(folder) + 1 :] if folder else path, is_folder):
                return not rule.taken_back
    return False


def walked(spark: SparkSession, root: str, ignored_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(path) of the files under a folder that no rule ignores, relative to it.

    Folders of a level are listed in parallel, each with the rules of the folders above it; an ignored folder is not
    entered, so nothing in it can be taken back.  Links to folders are not followed.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            out = {"path": [], "is_folder": [], "rules": []}
            for row in batch.to_pylist():
                folder, rules = row["path"], list(row["rules"])
                where = f"{top}/{folder}" if folder else top
                found = system.get_file_info(pafs.FileSelector(where, allow_not_found=True))
                if any(i.base_name == RULES_FILE and i.is_file for i in found):
                    with system.open_input_stream(f"{where}/{RULES_FILE}") as stream:
                        rules.append({"folder": folder, "text": stream.read().decode("utf-8", "replace")})
                chain = [(r["folder"], rules_of(r["text"])) for r in rules]
                for info in found:
                    path = f"{folder}/{info.base_name}" if folder else info.base_name
                    is_folder = info.type == pafs.FileType.Directory
                    if is_folder and info.base_name in ignored_dirs or info.base_name == ".git" or ignored(path, is_folder, chain):
                        continue
                    out["path"].append(path)
                    out["is_folder"].append(is_folder)
                    out["rules"].append(rules if is_folder else [])
            kinds = {"path": pa.string(), "is_folder": pa.bool_(), "rules": pa.list_(pa.struct([("folder", pa.string()), ("text", pa.string())]))}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    level = spark.createDataFrame([("", True, [])], _LISTED)
    files, n = spark.createDataFrame([], "path string"), 1
    while n:
        level = materialise(level.repartition(-(-n // FOLDERS_A_TASK)).mapInArrow(listed, _LISTED))
        files = files.unionByName(level.where("not is_folder").select("path"))
        level = level.where("is_folder")
        n = level.count()
    return files


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of relative paths, read where the rows are; what is no UTF-8 is replaced, what is gone by now is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{top}/{path}") as stream:
                        text = stream.read().decode("utf-8", "replace")
                except OSError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], names=["path", "content"])

    return files.select("path").repartition(F.col("path")).mapInArrow(read, "path string, content string")
