"""External row functions, such as learned models, over batches of rows, with their transposed derivatives.

The function and its derivative get and give numpy arrays of a batch; Spark moves the batches by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``forward(x)``: (n, inputs) to (n, outputs); ``vjp(x, g)``: with cotangents g of the outputs to those of the inputs."""

    forward: Callable[[np.ndarray], np.ndarray]
    vjp: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(columns: tuple[pd.Series, ...]) -> np.ndarray:
    return np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)


def apply_stage(stage: Stage, *inputs: Column) -> Column:
    """An array column of the outputs for each row's inputs."""
    forward = stage.forward

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(forward(_matrix(batch)), dtype=np.float64)))

    return F.pandas_udf(run, "array<double>")(*inputs)


def pull_back(stage: Stage, inputs: list[Column], cotangents: list[Column]) -> Column:
    """An array column of the inputs' cotangents."""
    n, vjp = len(inputs), stage.vjp

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(vjp(_matrix(batch[:n]), _matrix(batch[n:])), dtype=np.float64)))

    return F.pandas_udf(run, "array<double>")(*inputs, *cotangents)


def dense(weights: list[np.ndarray], biases: list[np.ndarray]) -> Stage:
    """Dense layers with tanh between them: weights (inputs, outputs) and biases per layer."""

    def layers(x: np.ndarray) -> list[np.ndarray]:
        held = [x]
        for k, (w, b) in enumerate(zip(weights, biases, strict=True)):
            x = held[-1] @ w + b
            held.append(np.tanh(x) if k < len(weights) - 1 else x)
        return held

    def vjp(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        held = layers(x)
        for k in reversed(range(len(weights))):
            if k < len(weights) - 1:
                g = g * (1 - held[k + 1] ** 2)
            g = g @ weights[k].T
        return g

    return Stage(lambda x: layers(x)[-1], vjp)


def with_outputs(table: DataFrame, stage: Stage, inputs: list[str], names: list[str]) -> DataFrame:
    """``table`` and a column per output."""
    out = table.withColumn("__y", apply_stage(stage, *(F.col(c) for c in inputs)))
    return out.select(*table.columns, *(F.col("__y")[k].alias(n) for k, n in enumerate(names)))
