"""File events as a stream: filter, debounce, and what each event means given what is known of its path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweave.operators.lookups import watched

OUT = "path string, event string, at timestamp"


def filtered(events: DataFrame, extensions: list[str], ignored_dirs: list[str], ignored_files: list[str]) -> DataFrame:
    """Events (path, kind, at) of watched paths; counts of all and of those left are observed as ``received`` and ``kept``."""
    kept = watched(F.col("path"), extensions, ignored_dirs, ignored_files)
    return events.observe("watch", F.count(F.lit(1)).alias("received"), F.count_if(kept).alias("kept")).where(kept)


def debounced(events: DataFrame, gap: str = "100 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """The last event of each burst of a path: a burst ends where no event follows within ``gap``."""
    rows = events.withWatermark("at", lateness) if events.isStreaming else events
    g = rows.groupBy("path", F.session_window("at", gap)).agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("last"))
    return g.select("path", "kind", F.col("last").alias("at"))


def meaning(kind: str, known: bool, exists: bool = True) -> tuple[str | None, bool]:
    """(event, known afterwards) of a raw event."""
    if kind in ("create", "modify", "rename"):
        if not exists:
            return ("Deleted", False) if known else (None, False)
        return ("Modified" if known or kind != "create" else "Created"), True
    if kind == "remove":
        return ("Deleted" if known else None), False
    return None, known


def normalised_batch(events: DataFrame, known: DataFrame) -> DataFrame:
    """(path, event, at) of a batch of events (path, kind, at), given known paths (path)."""
    def of_path(key: tuple, e: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        is_known, out = len(k) > 0, []
        for r in e.sort_values("at").itertuples():
            event, is_known = meaning(r.kind, is_known)
            if event:
                out.append((r.path, event, r.at))
        return pd.DataFrame(out, columns=["path", "event", "at"])

    return events.groupBy("path").cogroup(known.select("path").distinct().groupBy("path")).applyInPandas(of_path, OUT)


def normalised(events: DataFrame) -> DataFrame:
    """The same over a stream, with one known flag kept for each path (needs the RocksDB state store)."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Known(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("known", "known boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            is_known, out = bool(self.known.exists() and self.known.get()[0]), []
            for pdf in rows:
                for r in pdf.sort_values("at").itertuples():
                    event, is_known = meaning(r.kind, is_known)
                    if event:
                        out.append((r.path, event, r.at))
            self.known.update((is_known,))
            yield pd.DataFrame(out, columns=["path", "event", "at"])

        def close(self) -> None:
            pass

    return events.groupBy("path").transformWithStateInPandas(Known(), OUT, "Append", "None")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event) between two listings (path, content_hash)."""
    b = before.select("path", F.col("content_hash").alias("b"))
    a = after.select("path", F.col("content_hash").alias("a"))
    event = F.when(F.col("b").isNull(), "Created").when(F.col("a").isNull(), "Deleted").when(F.col("a") != F.col("b"), "Modified")
    return b.join(a, "path", "full_outer").select("path", event.alias("event")).where("event is not null")
