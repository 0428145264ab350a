"""A model that is loaded once a Python worker, applied to contents in small batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]):
    """The model of that name, loaded at its first use in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def encoded(rows: DataFrame, key: str, content: str, name: str, load: Callable[[], object], encode: Callable[[object, list], list], value: str, *, batch: int = 16) -> DataFrame:
    """(key, the column ``value``, error): ``encode(model, contents)`` gives one value a content.

    ``value`` is DDL, as in ``vec array<float>``. A batch that fails is tried content by content, so
    one broken content is one row with an error. A null content is an error and reaches no model.
    """
    column = value.split()[0]
    kind = rows.sparkSession.createDataFrame([], value).schema[0].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                contents = some.column(1).to_pylist()
                values, errors = [None] * len(contents), ["no content" if c is None else None for c in contents]
                at_hand = [k for k, c in enumerate(contents) if c is not None]
                model = loaded(name, load) if at_hand else None
                try:
                    for k, v in zip(at_hand, encode(model, [contents[k] for k in at_hand]) if at_hand else [], strict=True):
                        values[k] = v
                except Exception:  # noqa: BLE001 - whatever is wrong with a content becomes its row
                    for k in at_hand:
                        try:
                            (values[k],) = encode(model, [contents[k]])
                        except Exception as e:  # noqa: BLE001
                            values[k], errors[k] = None, f"{type(e).__name__}: {e}"[:2000]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(values, arrow), pa.array(errors, pa.string())], names=[key, column, "error"])

    return rows.select(key, content).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {value}, error string")
