"""Operators that look at a table's columns: choose, drop, prefix, strip nulls; batched maps and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What a supervised and a preference trainer read of a table (fixed values).
SUPERVISED = ("input_ids", "labels", "seq_lengths", "completion_mask", "assistant_masks")
PREFERENCE = ("prompt_input_ids", "chosen_input_ids", "rejected_input_ids")


def keep_signature(df: DataFrame, names: tuple[str, ...] = SUPERVISED) -> DataFrame:
    """The columns that a reader's signature has, in its order, as far as they are there."""
    return df.select(*[c for c in names if c in df.columns])


def drop_if_all(df: DataFrame, drop: list[str], present: list[str]) -> DataFrame:
    """df without some columns if all of a set of columns are there, else as it is."""
    return df.drop(*drop) if set(present) <= set(df.columns) else df


def tokenized(df: DataFrame, make: Callable[[DataFrame], Column], column: str = "input_ids", given: tuple[str, ...] = ("input_ids", "labels")) -> DataFrame:
    """df with a column of tokens, made only if the table has neither tokens nor labels yet."""
    return df if set(given) & set(df.columns) else df.withColumn(column, make(df))


def prefixed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """df with a prefix before the names of some columns."""
    return df.select(*[F.col(c).alias(prefix + c if c in columns else c) for c in df.columns])


def without_nulls(column: Column, kind: T.DataType) -> Column:
    """A value without the null elements of its arrays, at any depth; structs keep their fields."""
    if isinstance(kind, T.ArrayType):
        return F.filter(F.transform(column, lambda x: without_nulls(x, kind.elementType)), lambda x: x.isNotNull())
    if isinstance(kind, T.StructType):
        fields = F.struct(*[without_nulls(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), fields)
    return column


def map_batches(df: DataFrame, function: Callable[..., dict[str, list[Any]]], schema: str, **given: Any) -> DataFrame:
    """Rows that a function makes of batches: of columns as lists, with further arguments, to columns as lists.

    Values are Python's own: whole numbers stay whole beside nulls, which are None, and arrays are lists.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kinds)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = function({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}, **given)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(mapped, kinds)


def embedded(df: DataFrame, column: str, function: Callable[[pd.Series], pd.Series], name: str = "embedding") -> DataFrame:
    """df with a vector for each value of a column, by a function of a batch of values."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(values: pd.Series) -> pd.Series:
        return function(values)

    return df.withColumn(name, vectors(F.col(column)))
