"""Measures of the runs of equal keys in sorted Arrow batches.

Rows come dealt and sorted by their keys, so a group is one run of rows.
Whole runs are measured column by column with numpy; a run that a batch
breaks off waits for the next batch, so a task holds one batch and one group.
Groups of more rows than are to wait can be passed on unmeasured.

``map_series`` hands whole series (the rows of a key in order) to a function in
the same way.  What follows such a step in its task finds the series dealt and
in order, so a chain of them needs one exchange and one sort."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship_package


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a run begins; NULL is a key like others."""
    new = np.ones(len(table), bool)
    new[1:] = False
    for k in keys:
        c = table.column(k).combine_chunks()
        here, before = c.slice(1), c.slice(0, len(c) - 1)
        new[1:] |= pc.not_equal(here, before).fill_null(False).to_numpy(zero_copy_only=False)
        if c.null_count:
            new[1:] |= pc.not_equal(here.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _column(values, known=None) -> pa.Array:
    return pa.array(values, mask=None if known is None else ~known)


def _ordered(c: pa.Array, group: np.ndarray, groups: int, powers: int) -> dict[str, pa.Array]:
    """Count, sum, least, greatest and middle value of each group's numbers,
    taken as doubles, and the sums of the second and third powers about the mean.  Sums run
    over the values in ascending order."""
    there = c.is_valid().to_numpy(zero_copy_only=False)
    x, g = c.drop_null().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), group[there]
    n = np.bincount(g, minlength=groups)
    if len(x) > np.count_nonzero(n):  # otherwise no group has two values
        x = x[np.lexsort((x, g))]
    first, some = np.cumsum(n) - n, n > 0
    at = x if len(x) else np.zeros(1)

    def place(k):
        return at[np.where(some, first + k, 0)]
    low, high, least, most = place((n - 1) // 2), place(n // 2), place(0), place(n - 1)
    total = np.bincount(g, weights=x, minlength=groups)
    out = {"n": _column(n), "s": _column(total.astype(float)), "a": _column(least, some), "z": _column(most, some),
           "mid": _column(np.where(low == high, low, 0.5 * low + 0.5 * high), some)}
    # A constant group has no moments, whatever the rounding of its mean.
    constant = (least == most) | (np.isnan(least) & np.isnan(most))
    about = x - np.divide(total, n, out=np.zeros(groups), where=some)[g]
    power = about
    for k in range(2, powers + 1):
        power = power * about
        moment = np.bincount(g, weights=power, minlength=groups)
        out[f"m{k}"] = _column(np.where(constant, 0.0, moment).astype(float), n >= k)
    return out


def _distinct(c: pa.Array, group: np.ndarray, groups: int) -> dict[str, pa.Array]:
    """Count and distinct count of each group's values."""
    there = c.is_valid().to_numpy(zero_copy_only=False)
    coded, g = c.drop_null().dictionary_encode(), group[there]
    pairs = np.unique(g * len(coded.dictionary) + coded.indices.to_numpy())
    return {"n": _column(np.bincount(g, minlength=groups)),
            "d": _column(np.bincount(pairs // max(len(coded.dictionary), 1), minlength=groups))}


def _records(cells: dict[str, pa.Array], group: np.ndarray, groups: int) -> pa.Array:
    """The list of each group's distinct records, in the order of the rows.
    Records are the same if all fields are, bit by bit."""
    keep = np.ones(len(group), bool)
    several = np.flatnonzero(np.bincount(group, minlength=groups)[group] > 1)
    if len(several):
        codes = [group[several]]
        for c in cells.values():
            c = c.take(pa.array(several))
            c = c.view(pa.int64()) if pa.types.is_float64(c.type) else c
            codes.append(c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False))
        order = np.lexsort(codes[::-1])
        again = np.ones(len(order) - 1, bool)
        for c in codes:
            again &= c[order][1:] == c[order][:-1]
        keep[several[order[1:][again]]] = False
    made = pa.StructArray.from_arrays([c.filter(pa.array(keep)) for c in cells.values()], list(cells))
    ends = np.cumsum(np.bincount(group[keep], minlength=groups))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), made)


def measure_runs(rows: DataFrame, keys: list[str], powers: dict[str, int], distinct: list[str],
                 pass_above: int | None = None, records: list[str] = (), deal: list[str] | None = None) -> DataFrame:
    """One row per group: the keys, ``_n_c``, ``_s_c``, ``_a_c``, ``_z_c``,
    ``_mid_c`` (and ``_m2_c``, ``_m3_c`` up to the named power) of each
    number column of ``powers``, ``_n_c`` and ``_d_c`` of each column of
    ``distinct``, and ``_records``, the sorted distinct records of the columns
    ``records``.  A task holds the rows of a group.  ``deal``: the keys by
    which rows are dealt, all by default.

    With ``pass_above``, rows of a group that passes that many waiting rows
    come out as they are, every one of the group, with ``_whole`` false and
    no measures; measured groups have ``_whole`` true and no values."""
    ship_package(rows.sparkSession)
    kinds = {c: ["n", "s", "a", "z", "mid", *[f"m{k}" for k in range(2, p + 1)]] for c, p in powers.items()}
    kinds |= {c: ["n", "d"] for c in distinct}
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = [f"`{k}` {types[k]}" for k in keys] + [
        f"`_{kind}_{c}` {'bigint' if kind in 'nd' else 'double'}" for c, some in kinds.items() for kind in some]

    values = [*powers, *distinct] if pass_above else []
    ddl += [f"`{c}` {types[c]}" for c in values] + (["_whole boolean"] if pass_above else [])
    ddl += ["_records array<struct<" + ", ".join(f"`{c}`: {types[c]}" for c in records) + ">>"] if records else []
    measures = [f"_{kind}_{c}" for c, some in kinds.items() for kind in some]

    def passed(table: pa.Table) -> pa.RecordBatch:
        empty = {m: pa.nulls(len(table), pa.int64() if m[1:3] in ("n_", "d_") else pa.float64()) for m in measures}
        out = {k: table.column(k).combine_chunks() for k in keys} | empty
        out |= {c: table.column(c).combine_chunks() for c in values} | {"_whole": _column(np.zeros(len(table), bool))}
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def measured(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        out = [table.column(k).combine_chunks().take(pa.array(starts)) for k in keys]
        names = list(keys)
        for c, some in kinds.items():
            cells = table.column(c).combine_chunks()
            made = _ordered(cells, group, len(starts), powers[c]) if c in powers else _distinct(cells, group, len(starts))
            out += [made[kind] for kind in some]
            names += [f"_{kind}_{c}" for kind in some]
        if pass_above:
            out += [pa.nulls(len(starts), table.schema.field(c).type) for c in values] + [_column(np.ones(len(starts), bool))]
            names += [*values, "_whole"]
        if records:
            out.append(_records({c: table.column(c).combine_chunks() for c in records}, group, len(starts)))
            names.append("_records")
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        large = None  # the key of the group that is being passed on
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*waiting, batch])
            starts = _starts(table, keys)
            if large and large == [table.column(k)[0] for k in keys]:
                end = int(starts[1]) if len(starts) > 1 else len(table)
                yield passed(table.slice(0, end))
                table, starts = table.slice(end), starts[1:] - end
            if len(starts) > 1:
                yield measured(table.slice(0, starts[-1]), starts[:-1])
            waiting = table.slice(starts[-1]).combine_chunks().to_batches() if len(starts) else []
            if pass_above and len(starts) and len(table) - starts[-1] > pass_above:
                large = [table.column(k)[-1] for k in keys]
                yield passed(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield measured(pa.Table.from_batches(waiting), np.zeros(1, int))
    if pass_above and records:
        raise ValueError("records are made of whole groups alone")
    taken = list(dict.fromkeys([*keys, *powers, *distinct, *records]))
    dealt = rows.select(*taken).repartition(*(deal or keys)).sortWithinPartitions(*keys, *records)
    return dealt.mapInArrow(run, ", ".join(ddl))


def map_series(rows: DataFrame, key: str, order: str, make: Callable, schema: StructType, dealt: bool = False) -> DataFrame:
    """``make(table, starts)`` of tables of whole series, which begin at the
    rows ``starts``: the rows of one ``key`` (NULL is one) in ``order``.  A task
    holds a batch and a series.  ``dealt``: rows come dealt by key and sorted by
    key and order within their task already, and nothing is moved."""
    ship_package(rows.sparkSession)

    def made(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        return make(table, _starts(table, [key])).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            last = int(_starts(pa.Table.from_batches([batch]), [key])[-1])
            whole = [*waiting, batch.slice(0, last)] if last else waiting
            at = batch.schema.get_field_index(key)
            if last or waiting and waiting[-1].column(at)[-1] != batch.column(at)[0]:
                yield from made(whole)
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from made(waiting)
    if not dealt:
        rows = rows.repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, schema)
