"""Parquet tables of events, and tables of states with their parameters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.hashing import hash64
from ..plans.groups import FLAT, StatGroup, Tables
from ..plans.stat import Stat

_PARAMETERS = "rillstats.parameters"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_keys(column: Column | str) -> Column:
    """64-bit keys of texts, for statistics of keys."""
    return hash64(column)


def _parameters(stat: Stat | StatGroup) -> str:
    if isinstance(stat, StatGroup):
        return json.dumps({"/".join(at): _parameters(s) for at, s in stat.leaves().items()})
    return json.dumps({"kind": type(stat).__name__, **{k: list(v) if isinstance(v, tuple) else v for k, v in stat.parameters().items()}}, sort_keys=True)


def save_group(state: Tables, group: StatGroup, path: str, mode: str = "errorifexists") -> None:
    """Write a group's state, a table for the flat members and one for each other."""
    for k, name in enumerate(state.tables):
        save_state(state.tables[name], group, f"{path}/{k}", mode)


def load_group(spark: SparkSession, group: StatGroup, path: str) -> Tables:
    """Read a group's state; one of other members or parameters raises an error."""
    found = {}
    wanted = [FLAT] * bool(group._flat()) + list(group._others())
    for k, name in enumerate(wanted):
        found[name] = load_state(spark, group, f"{path}/{k}")
    return Tables(found)


def save_state(state: DataFrame, stat: Stat | StatGroup, path: str, mode: str = "errorifexists") -> None:
    """Write a state with its statistic's parameters, which each column carries as metadata."""
    meta = {_PARAMETERS: _parameters(stat)}
    state.select(*(state[c].alias(c, metadata=meta) for c in state.columns)).write.mode(mode).parquet(path)


def load_state(spark: SparkSession, stat: Stat | StatGroup, path: str) -> DataFrame:
    """Read a state; one of other parameters raises an error."""
    df = spark.read.parquet(path)
    for field in df.schema.fields:
        if field.metadata.get(_PARAMETERS) != _parameters(stat):
            raise ValueError(f"the state in {path} has other parameters")
    return df
