"""Running totals over a whole table in a given order, without one task for a key or for the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoweave.llm.common import stored

_TOTAL, _PART = "_total", "_part"


def running_totals(rows: DataFrame, order: list[str | Column], key: str | None = None, weight: str | None = None, ranges: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``rows``, or their columns ``keep``, with ``_total`` long: the sum of ``weight`` (a row counts 1 without it) over the row and those before it in ``order``.

    With ``key``, a long or int column without nulls, totals begin anew for each key.  Weights are not negative.  Rows
    are sorted in ranges of (key, order), so a key that holds most rows is cut over many tasks; each range counts its
    own rows, and what its first key has in earlier ranges is added after.  On the driver there is one row for each
    range.  Rows that ``order`` does not tell apart come in any order.  Borders of ranges are sampled keys and held by the
    driver; where ``order`` has long texts, ``ranges`` gives short columns that rise with it to cut by.
    """
    by = [*([F.col(key)] if key else []), *[F.col(c) if isinstance(c, str) else c for c in order]]
    at = keep or rows.columns
    laid = rows.repartitionByRange(*(by if ranges is None else [*by[: bool(key)], *ranges])).sortWithinPartitions(*by).select(*at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            step = batch.column(at.index(weight)).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.ones(n, np.int64)
            total = np.cumsum(step)
            if key:
                keys = batch.column(at.index(key)).to_numpy(zero_copy_only=False)
                start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                before = (total - step)[start]
                if last is not None and keys[0] == last:
                    before[0] -= held
                total = total - np.repeat(before, np.diff(np.append(start, n)))
                last = keys[-1]
            else:
                total = total + held
            held = int(total[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total), pa.array(np.full(n, part, np.int32))], names=[*at, _TOTAL, _PART])

    local = stored(laid.mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema), f"{_TOTAL} long", f"{_PART} int"])))
    same = F.col(key) if key else F.lit(0)
    ranges = local.groupBy(_PART).agg(F.min(same).alias("first"), F.max(F.struct(same.alias("last"), _TOTAL)).alias("end")).orderBy(_PART).collect()
    carried, last, held = [], None, 0
    for r in ranges:
        mine = held if r["first"] == last else 0
        if mine:
            carried.append((r[_PART], r["first"], mine))
        held = r["end"][_TOTAL] + (mine if r["end"]["last"] == r["first"] else 0)
        last = r["end"]["last"]
    if not carried:
        return local.drop(_PART)
    more = rows.sparkSession.createDataFrame(carried, "_p int, _k long, _more long")
    out = local.join(more, (F.col(_PART) == F.col("_p")) & (same == F.col("_k")), "left")
    return out.select(*[F.col(f"`{c}`") for c in at], (F.col(_TOTAL) + F.coalesce("_more", F.lit(0))).alias(_TOTAL))
