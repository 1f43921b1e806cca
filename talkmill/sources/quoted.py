"""CSV whose quoted fields may hold line breaks, read by many tasks.

A line either begins inside a quoted field or does not. For each line there is a state it ends in for both; a line without
quotes changes nothing, and other lines are told apart by two patterns. A record ends with a line that ends
outside. Empty lines outside are no records.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.once import with_once
from talkmill.sources.ranges import Chunks, of_split, read_chunks, split_key, split_runs

ROW, FILE, HEADER = "__row", "__file", "__header"

_CLOSED = '"(?:[^"]|"")*"(?:[^",][^,]*)?'
_FIELDS = f'(?:(?:[^",][^,]*|{_CLOSED})?,)*'
_OPEN = '"(?:[^"]|"")*'
#: A line that begins outside and ends inside a quoted field, and one that does both inside.
OPENS = f"^{_FIELDS}{_OPEN}$"
STAYS = f'^(?:[^"]|"")*(?:"(?:[^",][^,]*)?,{_FIELDS}{_OPEN})?$'


def _states():
    """A function from lines to the states they end in, from the state that the first begins in."""
    opens, stays = OPENS, STAYS

    def effects(lines):
        """State after each line if it begins outside, and if inside."""
        import numpy as np
        import pyarrow.compute as pc

        outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        if len(quoted):
            some = lines.take(quoted)
            outside[quoted] = pc.match_substring_regex(some, opens).to_numpy(zero_copy_only=False)
            inside[quoted] = pc.match_substring_regex(some, stays).to_numpy(zero_copy_only=False)
        return outside, inside

    def after(outside, inside, begin: bool):
        """A line that ends alike from both states fixes the state; the others since then keep or turn it."""
        import numpy as np

        fixed = outside == inside
        last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
        turns = np.cumsum(outside & ~inside)
        base = np.where(last >= 0, outside[last], begin)
        since = turns - np.where(last >= 0, turns[last], 0)
        return base ^ (since % 2 == 1)

    def ends(lines, state, begin: bool):
        """Where records end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        before = np.concatenate([[begin], state[:-1]])
        empty = pc.is_in(lines, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        return ~state & ~(empty & ~before), empty & ~before

    return effects, after, ends


def _measure():
    runs, (effects, after, ends) = split_runs(), _states()

    def task(batches):
        import pyarrow as pa

        def row():
            text = "\n".join(head) if whole else None
            columns = [*([k] for k in at), [state[0]], [state[1]], [count[0]], [count[1]], [text]]
            kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
            names = ["file", "start", "length", "size", "out", "in", "rows_out", "rows_in", "head"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        at = None
        for key, lines in runs(batches):
            if at != key:
                if at:
                    yield row()
                at = key
                state, count, head, whole = [False, True], [0, 0], [], False
            outside, inside = effects(lines)
            for k in range(2):
                found = after(outside, inside, state[k])
                ended, empty = ends(lines, found, state[k])
                if k == 0 and key[1] == 0 and not whole:
                    stop = int(ended.argmax()) + 1 if ended.any() else len(lines)
                    head += [lines[i].as_py() for i in range(stop) if not empty[i]]
                    whole = bool(ended.any())
                count[k] += int(ended.sum())
                state[k] = bool(found[-1])
        if at:
            yield row()

    return task


def _cutter(splits: dict[tuple, tuple]):
    """Makers of the task that gives whole records, and of the one that gives fragments."""
    runs, (effects, after, ends), known = split_runs(), _states(), of_split(splits)

    def cutter(fragments: bool):
        def task(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            names = ["file", "name", "row", "header", "part", "record"]

            def batch(rows, part, records):
                many = len(records)
                columns = [pa.array([at[0]] * many, pa.int64()), pa.array([name] * many, pa.string()), pa.array(rows, pa.int64()), pa.array([header] * many, pa.int32()), pa.array([part] * many, pa.int64()), records]
                return pa.RecordBatch.from_arrays(columns, names)

            def rest():
                """What is left at the end of a split."""
                if held and fragments:
                    yield batch([number], at[1], pa.array(["\n".join(held)]))

            at = None
            for key, lines in runs(batches):
                if at != key:
                    if at:
                        yield from rest()
                    at = key
                    name, header, state, number = known(key)
                    held, broken = [], state
                outside, inside = effects(lines)
                found = after(outside, inside, state)
                ended, empty = ends(lines, found, state)
                state = bool(found[-1])
                if empty.any():
                    keep = np.flatnonzero(~empty)
                    lines, ended = lines.take(keep), ended[keep]
                stops = np.flatnonzero(ended) + 1
                if not len(stops):
                    held += lines.to_pylist()
                    continue
                opening = [*held, *lines.slice(0, stops[0]).to_pylist()]
                held = lines.slice(stops[-1]).to_pylist()
                if broken and fragments:
                    yield batch([number], at[1], pa.array(["\n".join(opening)]))
                if not fragments:
                    if not broken:
                        yield batch([number], None, pa.array(["\n".join(opening)]))
                    inner = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), lines), "\n")
                    yield batch(np.arange(number + 1, number + len(stops)), None, inner)
                broken, number = False, number + len(stops)
            if at:
                yield from rest()

        return task

    return cutter


def csv_records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(``name, row, header, record``: every record with its file, its number there and the file's header, the headers).

    Record 0 of a file is the header itself.
    """
    chunks: Chunks = read_chunks(spark, paths, "\n")
    measured = chunks.measured(_measure(), "out boolean, in boolean, rows_out long, rows_in long, head string")
    splits, headers, crossing = {}, {}, False
    for file, found in sorted(measured.items(), key=lambda item: chunks.files[item[0]].path):
        state, row = False, 0
        if found[0]["head"] is None:
            raise ValueError(f"no header in the first split of {chunks.files[file].path}")
        header = headers.setdefault(found[0]["head"].removesuffix("\r").removeprefix("\ufeff"), len(headers))
        for split in found:
            splits[split_key(split)] = chunks.files[file].name, header, state, row
            row += split["rows_in" if state else "rows_out"]
            state = split["in" if state else "out"]
            crossing |= state
    records = chunks.cut(_cutter(splits), "name string, row long, header int", crossing, ["file", "row"], "\n")
    return records, list(headers)


def _fields(header: str) -> list[str]:
    """Names of a header, empty ones and repeated ones made distinct by their place."""
    names = next(csv.reader(header.split("\n") if "\n" not in header else [line + "\n" for line in header.split("\n")]), [])
    return [f"{n}{k}" if names.index(n) < k else n or f"_c{k}" for k, n in enumerate(names)]


def read_quoted(spark: SparkSession, paths: str | list[str], options: dict) -> tuple[DataFrame, list[list[str]]]:
    """(rows, names by header): every field as text, with ``__file``, ``__row`` (from 0 in each file) and ``__header``.

    Files may differ in their columns; what a file lacks is null. All are one scan.
    """
    records, headers = csv_records(spark, paths)
    names = [_fields(header) for header in headers]
    schema = ", ".join(f"c{k} string" for k in range(max(map(len, names), default=1)))
    data = records.filter("row > 0").withColumn("record", F.regexp_replace("record", "\r\\z", ""))
    parsed = with_once(data, {"fields": F.from_csv("record", schema, options)})

    def field(name: str) -> Column:
        places = {k: own.index(name) for k, own in enumerate(names) if name in own}
        if len(set(places.values())) == 1 and len(places) == len(names):
            return F.col(f"fields.c{places[0]}")
        of_header = [F.when(F.col("header") == k, F.col(f"fields.c{place}")) for k, place in places.items()]
        return F.coalesce(*of_header)

    every = list(dict.fromkeys(n for own in names for n in own))
    rows = parsed.select(
        *[field(n).alias(n) for n in every],
        F.col("name").alias(FILE),
        (F.col("row") - 1).alias(ROW),
        F.col("header").alias(HEADER),
    )
    return rows, names
