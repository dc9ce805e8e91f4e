"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Terms that a task keeps counters of before it hands them on.
HELD_TERMS = 500_000


class LastSeen:
    """Counters (occurrences, records, last record) of each term, over tokens that come record by record.

    A record counts for a term when it differs from the last one in which the term was
    seen, so no set of records, nor of a record's terms, is held.  A batch is first
    reduced to one row a term with numpy; its first record is then compared with the
    last one seen.
    """

    def __init__(self) -> None:
        self.held: dict[tuple, list] = {}

    def add(self, keys: list[np.ndarray], names: list[list], record: np.ndarray) -> None:
        """``keys`` are codes of the group columns and the term, into ``names``; ``record`` are codes that differ between records."""
        if not len(record):
            return
        # a stable order by key leaves the tokens of each key in the order of records
        order = np.lexsort(keys[::-1])
        k, r = [x[order] for x in keys], record[order]
        edge = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in k])])
        seen = edge | np.concatenate([[True], r[1:] != r[:-1]])
        at = np.flatnonzero(edge)
        occurrences, records = np.diff(np.append(at, len(r))), np.add.reduceat(seen.astype(np.int64), at)
        last = r[np.append(at[1:], len(r)) - 1]
        for i, start in enumerate(at.tolist()):
            key = tuple(n[x[start]] for n, x in zip(names, k, strict=True))
            state = self.held.get(key)
            if state is None:
                self.held[key] = [int(occurrences[i]), int(records[i]), int(last[i])]
            else:
                state[0] += int(occurrences[i])
                state[1] += int(records[i]) - (state[2] == r[start])
                state[2] = int(last[i])

    def flush(self) -> list[list]:
        """The counters by column, which are then forgotten."""
        rows = [(*k, v[0], v[1]) for k, v in self.held.items()]
        self.held = {}
        return [list(c) for c in zip(*rows, strict=True)] if rows else []


def term_counts(tokens: DataFrame, group: list[str], gathered: bool = False) -> DataFrame:
    """(group, term, occurrences, records) of tokens (group, term, record).

    Tokens are hashed by record and ordered by it; each task passes over its records
    with last-seen counters and hands on one row a term, at the latest when it holds
    HELD_TERMS of them, always between two records.  These rows, not the tokens, are
    hashed by term and added, so a term of every record is no hot key.  With ``gathered``
    the tokens of a record already lie next to each other in one task, as when they were
    exploded from one row, and are not moved.  Null terms are no tokens; a null record
    counts as one record of its own.
    """
    kinds = dict(tokens.dtypes)
    shown = tokens.select(*group, "term", "record")
    if not gathered:
        shown = shown.repartition("record").sortWithinPartitions("record")
    n = len(group)
    columns = [*group, "term"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number, before = LastSeen(), 0, None

        def emit() -> Iterator[pa.RecordBatch]:
            out = seen.flush()
            if out:
                kept = [pa.array(c, schema.field(i).type) for i, c in enumerate(out)]
                yield pa.RecordBatch.from_arrays(kept, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([*[batch.schema.field(i).with_nullable(True) for i in range(n + 1)], pa.field("occurrences", pa.int64()), pa.field("records", pa.int64())])
            coded = [_codes(batch.column(i)) for i in range(n + 2)]
            record, values = coded[-1][0], coded[-1][1]
            # runs of one record are numbered on, so that the number differs from record to record
            change = np.concatenate([[number == 0 or values[record[0]] != before], record[1:] != record[:-1]])
            numbers = number + np.cumsum(change)
            number, before = int(numbers[-1]), values[record[-1]]
            is_term = ~np.asarray(batch.column(n).is_null())
            first = numbers[0]
            head = is_term & (numbers == first)
            if len(seen.held) >= HELD_TERMS and number > first:
                # the record that began before ends in this batch
                seen.add([c[0][head] for c in coded[:-1]], [c[1] for c in coded[:-1]], numbers[head])
                yield from emit()
                is_term &= ~head
            seen.add([c[0][is_term] for c in coded[:-1]], [c[1] for c in coded[:-1]], numbers[is_term])
        if number:
            yield from emit()

    spec = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", occurrences bigint, records bigint"
    partial = shown.mapInArrow(count, spec)
    return partial.groupBy(*columns).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Integer codes of a column, nulls included, and their values."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def marked(counts: DataFrame, totals: DataFrame, group: list[str], rare: int = 2, common: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: rare, common or null.  ``totals`` (group, total) has one row a group."""
    joined = counts.join(F.broadcast(totals), group)
    return joined.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("total") * common, "common"))


def name_words(name: str) -> Column:
    """Words of at least three ASCII letters, lower-cased; a capital after a small letter starts a word."""
    split = F.regexp_replace(F.col(name), "([a-z])(?=[A-Z])", "$1 ")
    return F.filter(F.regexp_extract_all(F.lower(split), F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= 3)
