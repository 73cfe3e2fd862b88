"""Relations: a lazy DataFrame with the keys that identify its rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class RequestError(ValueError):
    """A request that can't be answered as it stands."""


@dataclass(frozen=True)
class Grain:
    """The columns that tell rows apart; no keys: a single row. Grains are equal only with equal labels."""

    keys: tuple[str, ...]
    label: str | None = None

    def __post_init__(self):
        if any(not k for k in self.keys):
            raise ValueError("a grain key is empty")
        if len(set(self.keys)) < len(self.keys):
            raise ValueError(f"grain keys repeat: {', '.join(self.keys)}")


PITCH = Grain(("pitch_uid",), "pitch")
PLATE_APPEARANCE = Grain(("game_pk", "at_bat_number"), "plate_appearance")
GAME = Grain(("game_pk",), "game")
SCALAR = Grain((), "scalar")


def checked(name: str) -> str:
    if not NAME.match(name):
        raise RequestError(f"not a column name: {name!r}")
    return name


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    grain: Grain

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def need(self, *names: str) -> None:
        missing = [n for n in names if n not in self.df.columns]
        if missing:
            raise RequestError(f"unknown field: {', '.join(missing)}")

    def need_new(self, *names: str) -> None:
        for n in names:
            if checked(n) in self.df.columns:
                raise RequestError(f"the name is taken: {n}")

    def type_of(self, name: str) -> DataType:
        self.need(name)
        return self.df.schema[name].dataType

    def is_numeric(self, name: str) -> bool:
        return isinstance(self.type_of(name), NumericType)

    def with_df(self, df: DataFrame, grain: Grain | None = None) -> Relation:
        """The next relation; its grain's keys must be there."""
        grain = self.grain if grain is None else grain
        lost = [k for k in grain.keys if k not in df.columns]
        if lost:
            raise RequestError(f"grain keys are lost: {', '.join(lost)}")
        return Relation(df, grain)

    def assert_grain(self) -> Relation:
        """Run a query that fails if the declared keys repeat (for debugging)."""
        if self.grain.keys:
            repeats = self.df.groupBy(*self.grain.keys).count().where("count > 1").limit(1).count()
        else:
            repeats = self.df.limit(2).count() > 1
        if repeats:
            raise ValueError(f"rows repeat at grain {self.grain}")
        return self


def order_keys(keys: Iterable[str | tuple[str, bool]]) -> list:
    """Columns to order by, nulls last either way. A key is a name or (name, descending)."""
    out = []
    for k in keys:
        name, down = (k, False) if isinstance(k, str) else k
        out.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    return out
