"""JSON files that are one large list, read by many tasks.

The text source separates a file at closing braces, so a list of objects on a single line splits as well. Every split is measured
for both states it may begin in, inside a string or not: how it changes that state and the depth, and how many
commas and closing braces it has at each depth relative to its begin. From these numbers the driver knows the state, the
depth and the number of list items before each split. The second scan cuts the list after each object item: a segment is one object and
the other items before it. Other JSON values, a file with one object among them, stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkmill.sources.ranges import of_split, read_chunks, split_key, split_runs

LIST, VALUE, BROKEN = "list", "value", "broken"


def _scanner():
    """A function from bytes to the structural characters outside strings, for a state the bytes begin in."""

    def quotes(data):
        """Places of quotes that are not escaped: after an even number of backslashes."""
        import numpy as np

        found = np.flatnonzero(data == 34)
        after = found[(found > 0) & (data[found - 1] == 92)]
        if not len(after):
            return found
        other = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1))
        escaped = after[(after - 1 - other[after - 1]) % 2 == 1]
        return np.setdiff1d(found, escaped, assume_unique=True)

    def structure(data):
        """Places of braces, brackets and commas, what they add to the depth, and whether they lie behind an odd number of quotes."""
        import numpy as np

        adds = np.zeros(256, np.int8)
        adds[[91, 123]], adds[[93, 125]], adds[44] = 1, -1, 2
        kind = adds[data]
        places = np.flatnonzero(kind)
        marks = quotes(data)
        kind = kind[places]
        return places, np.where(kind == 2, 0, kind), np.searchsorted(marks, places) % 2 == 1, len(marks) % 2 == 1

    return structure


def _measure():
    runs, structure = split_runs(), _scanner()

    def task(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        names = ["file", "start", "length", "size", "bytes", "first", "last", "turns", "depth_out", "depth_in", "commas_out", "commas_in", "closes_out", "closes_in", "braces_out", "braces_in"]
        counts = pa.map_(pa.int64(), pa.int64())
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()] + [counts] * 6

        def row():
            columns = [*at, read, first, last, turned, *depth, *(sorted(c.items()) for group in (commas, closes, braces) for c in group)]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names)

        at = None
        for key, values in runs(batches):
            if at != key:
                if at:
                    yield row()
                at = key
                read, first, last, turned, depth = 0, None, None, False, [0, 0]
                commas, closes, braces = ([Counter(), Counter()] for _ in range(3))
            raw = b"".join([v + b"}" for v in values.cast(pa.binary()).to_pylist()])
            data = np.frombuffer(raw, np.uint8)
            places, adds, odd, turn = structure(data)
            for k in range(2):
                outside = odd == (turned ^ bool(k))
                some, add = data[places[outside]], adds[outside]
                level = depth[k] + np.cumsum(add, dtype=np.int64)
                for counter, chosen in ((commas[k], some == 44), (closes[k], add < 0), (braces[k], some == 125)):
                    keys, n = np.unique(level[chosen], return_counts=True)
                    counter.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                depth[k] = int(level[-1]) if len(level) else depth[k]
            turned ^= turn
            text = raw.strip(b" \t\r\n")
            first = first or text[:1].decode("latin-1") or None
            # The brace behind the last chunk of a file may be ours; the driver knows, and wants the letter before it.
            last = raw[:-1].strip(b" \t\r\n")[-1:].decode("latin-1") or ("}" if read else None)
            read += len(raw)
        if at:
            yield row()

    return task


_MEASURED = "bytes long, first string, last string, turns boolean, depth_out long, depth_in long, " + ", ".join(
    f"{name}_{side} map<long,long>" for name in ("commas", "closes", "braces") for side in ("out", "in")
)


def _cutter(splits: dict[tuple, tuple]):
    runs, structure, known = split_runs(), _scanner(), of_split(splits)

    def cutter(fragments: bool):
        def task(batches):
            import numpy as np
            import pyarrow as pa

            names = ["file", "name", "segment", "base", "kind", "part", "record"]

            def batch(segments, bases, part, records):
                many = len(records)
                columns = [pa.array([at[0]] * many, pa.int64()), pa.array([name] * many, pa.string()), pa.array(segments, pa.int64()), pa.array(bases, pa.int64()), pa.array([kind] * many, pa.string()), pa.array([part] * many, pa.int64()), records]
                return pa.RecordBatch.from_arrays(columns, names)

            def one(text, part):
                return batch([segment], [base], part, pa.array([text if text is None else text.decode("utf-8", "replace")], pa.string()))

            def rest():
                """The end of a split: a fragment, or the end of the list or value."""
                text = b"".join(held)[: -1 if ours else None]
                if kind == BROKEN:
                    if at[1] == 0 and not fragments:
                        yield one(None, None)
                elif closing and not begun:
                    if not fragments:
                        yield one(text, None)
                elif text and fragments:
                    yield one(text, at[1])

            at = None
            for key, values in runs(batches):
                if at != key:
                    if at:
                        yield from rest()
                    at = key
                    name, kind, inside, depth, commas, segment, begun, closing, ours = known(key)
                    held, base = [], commas
                raw = b"".join([v + b"}" for v in values.cast(pa.binary()).to_pylist()])
                if kind != LIST:
                    if kind == VALUE:
                        held.append(raw)
                    continue
                data = np.frombuffer(raw, np.uint8)
                places, adds, odd, turn = structure(data)
                outside = odd == inside
                inside ^= turn
                places, add = places[outside], adds[outside]
                level = depth + np.cumsum(add, dtype=np.int64)
                depth = int(level[-1]) if len(level) else depth
                found = data[places]
                before = commas + np.cumsum((found == 44) & (level == 1))
                commas = int(before[-1]) if len(before) else commas
                ends = np.flatnonzero((found == 125) & (level == 1))
                if not len(ends):
                    held.append(raw)
                    continue
                stops = places[ends] + 1
                if begun == fragments:
                    yield one(b"".join([*held, raw[: stops[0]]]), at[1] if fragments else None)
                if not fragments and len(stops) > 1:
                    inner = pa.StringArray.from_buffers(len(stops) - 1, pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(raw))
                    yield batch(np.arange(segment + 1, segment + len(stops)), before[ends[:-1]], None, inner)
                held, begun = [raw[stops[-1] :]], False
                segment, base = segment + len(stops), int(before[ends[-1]])
            if at:
                yield from rest()

        return task

    return cutter


def _composed(found: list) -> tuple[str, list[tuple], bool]:
    """A file's kind; for each split: inside a string, depth, commas of the list before it, segments before it; a brace too many."""
    inside, depth, commas, segments, closed, states = False, 0, 0, 0, 0, []
    for split in found:
        states.append((inside, depth, commas, segments))
        side = "in" if inside else "out"
        commas += split[f"commas_{side}"].get(1 - depth, 0)
        segments += split[f"braces_{side}"].get(1 - depth, 0)
        closed += split[f"closes_{side}"].get(-depth, 0)
        depth += split[f"depth_{side}"]
        inside ^= split["turns"]
    # A byte order mark is not given out; the brace behind the last chunk may not be in the file.
    ours = sum(split["bytes"] for split in found) - found[0]["size"] in (1, -2)
    first = next((split["first"] for split in found if split["first"]), "")
    last = (found[-1]["last"] or "}" if len(found) > 1 else found[0]["last"] or "") if ours else "}"
    if first not in ("[", "{"):
        return VALUE, states, ours
    whole = not inside and depth + ours == 0 and closed == 1 and first + last in ("[]", "{}")
    return (LIST if first == "[" else VALUE) if whole else BROKEN, states, ours


def json_segments(spark: SparkSession, paths: str | list[str], pattern: str | None = "*.json") -> DataFrame:
    """``source_file, segment, base, kind, record``: segments of lists with the number of the list's commas before them, other values whole.

    A list that does not close is one row of kind ``broken`` without a record, and so is an empty file.
    """
    chunks = read_chunks(spark, paths, "}", pattern)
    measured = chunks.measured(_measure(), _MEASURED)
    splits, crossing = {}, False
    for file, found in measured.items():
        kind, states, ours = _composed(found)
        for k, (split, (inside, depth, commas, segments)) in enumerate(zip(found, states, strict=True)):
            closing = k == len(found) - 1
            begun = k > 0 and not (kind == LIST and depth == 1 and not inside)
            name = chunks.files[file].name
            splits[split_key(split)] = name, kind, inside, depth, commas, segments if kind == LIST else 0, begun, closing, closing and ours
            crossing |= begun and kind != BROKEN
    schema = "name string, segment long, base long, kind string"
    records = chunks.cut(_cutter(splits), schema, crossing, ["file", "segment"], "").withColumnRenamed("name", "source_file")
    empty = [(chunks.files[file].name, 0, 0, BROKEN, None) for file in chunks.files if file not in measured]
    return records.unionByName(spark.createDataFrame(empty, records.schema)) if empty else records
