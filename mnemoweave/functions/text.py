"""Strings, paths, ids and hashes."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "basename", "cut_tokens", "content_hash", "descriptor", "language_of", "module_name", "path_category", "path_stem", "project_of", "python_parses",
    "quoted", "session_project", "set_hash", "shortened", "signatures", "stable_id", "tool_summary", "type_label", "type_name", "exact_tokens",
]

#: Extensions and their languages.
LANGUAGES = {"py": "Python", "rs": "Rust", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScriptJsx", "ts": "TypeScript", "tsx": "TypeScriptTsx", "go": "Go"}
SOURCE_ROOTS = ("src", "lib", "source", "sources")
KNOWN_TYPES = ("Person", "Project", "Technology", "Organization", "Location", "Decision", "Concept", "Document")


def shortened(text: Column, limit: int = 200) -> Column:
    """The text, or its first characters without trailing space and three dots where it is over ``limit``."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def quoted(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """The last segment without its last extension; a leading dot does not start one."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def path_category(relative: Column) -> Column:
    """The memory category of a path under the memory root, by its first directory."""
    top = F.lower(F.regexp_extract(relative, r"^/?([^/]+)/", 1))
    by = F.when(top == "associates", "Semantic").when(top == "work", "Procedural").otherwise("Episodic")
    return F.when(relative.contains("://"), "Episodic").otherwise(by)


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(pairs[extension], F.lit("Unknown"))


def module_name(path: Column) -> Column:
    """Dotted module of a source path, without a source root, the extension and a final ``__init__``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    parts = F.when(F.get(parts, 0).isin(*SOURCE_ROOTS), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    dotted = F.regexp_replace(F.array_join(parts, "."), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def session_project(source: Column) -> Column:
    """The project in a session URI; null for any other source."""
    found = F.regexp_extract(source, r"^claude-session://([^/]+)/", 1)
    return F.when(found != "", found)


def project_of(cwd: Column, folder: Column) -> Column:
    """The working directory's last segment, else what follows the last dash of the session folder."""
    last = basename(F.regexp_replace(cwd, "/+$", ""))
    return F.coalesce(F.when(last != "", last), F.element_at(F.split(folder, "-"), -1))


def tool_summary(name: Column, arguments: Column) -> Column:
    """``Name: file`` or ``Name: command`` of a tool call with JSON arguments, else its name."""
    path = F.coalesce(F.get_json_object(arguments, "$.file_path"), F.get_json_object(arguments, "$.path"), F.get_json_object(arguments, "$.pattern"))
    command = F.get_json_object(arguments, "$.command")
    return F.when(path != "", F.concat(name, F.lit(": "), basename(path))).when(command != "", F.concat(name, F.lit(": "), F.substring(command, 1, 60))).otherwise(name)


def descriptor(name: Column, kind: Column, aliases: Column, neighbours: Column, stems: Column) -> Column:
    """The one-line text an entity is embedded by."""
    listed = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ", ")))
    return F.concat_ws(" | ", F.concat(name, F.lit(" ("), kind, F.lit(")")), listed("aka: ", aliases, 4), listed("Co-occurs with: ", neighbours, 7), listed("Sources: ", stems, 3))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def set_hash(values: Column) -> Column:
    """A 64-bit hash of an array that does not depend on its order."""
    return F.xxhash64(F.array_sort(values))


def stable_id(*parts: Column) -> Column:
    """An id that is the same on every recomputation."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def type_name(kind: Column) -> Column:
    """The plain type of a possibly wrapped one, ``{"Custom": "Goal"}``."""
    return F.coalesce(F.get_json_object(kind, "$.Custom"), kind)


def type_label(kind: Column) -> Column:
    """How statistics print a type: others than the known ones as ``Custom(x)``."""
    return F.when(kind.isin(*KNOWN_TYPES), kind).otherwise(F.concat(F.lit("Custom("), kind, F.lit(")")))


def signatures(source: Column) -> Column:
    """The lines of a source text that begin a definition."""
    return F.array_join(F.filter(F.split(source, "\n"), lambda x: F.ltrim(x).rlike(r"^(def |class |async def |fn )")), "\n")


def cut_tokens(text: Column, limit: int, marker: str = "\n[truncated]") -> Column:
    """The text, or its beginning of ``limit`` tokens of four characters and a marker."""
    return F.when(F.length(text) > limit * 4, F.concat(F.substring(text, 1, limit * 4), F.lit(marker))).otherwise(text)


def exact_tokens(count_all):
    """A pandas UDF that counts tokens with ``count_all(list of texts) -> list of ints``."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_all(texts.fillna("").tolist()), dtype="int32")

    return count


def python_parses(source: Column, language: Column) -> Column:
    """struct<valid, line, message>: whether Python source parses; any other language is taken as valid."""

    @F.pandas_udf("struct<valid boolean, line int, message string>")
    def check(texts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        def one(text, kind):
            if kind != "Python":
                return True, None, None
            try:
                ast.parse(text or "")
            except (SyntaxError, ValueError) as e:
                return False, getattr(e, "lineno", None), str(e)
            return True, None, None

        return pd.DataFrame([one(t, k) for t, k in zip(texts, kinds)], columns=["valid", "line", "message"])

    return check(source, language)
