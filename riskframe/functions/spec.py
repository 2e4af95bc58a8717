"""Column roles of an applicant table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, NumericType, StringType


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are features, and which only identify or label a row.

    Integer-coded categories must be named: Spark has no categorical type.
    """

    id: str
    label: str | None = None
    sensitive: str | None = None
    numeric: tuple[str, ...] = field(default=())
    categorical: tuple[str, ...] = field(default=())

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @classmethod
    def infer(
        cls,
        df: DataFrame,
        id: str,
        label: str | None = None,
        sensitive: str | None = None,
        categorical: str | list[str] = "infer",
        ignore: list[str] | tuple[str, ...] = (),
    ) -> "FeatureSpec":
        """Roles by type, or with an explicit list of categorical columns.

        Columns keep the order of the schema. The sensitive column is not a
        feature unless listed as categorical.
        """
        skip = {id, label, *ignore}
        if sensitive and (categorical == "infer" or sensitive not in categorical):
            skip.add(sensitive)
        numeric, texts = [], []
        for f in df.schema.fields:
            if f.name in skip:
                continue
            if categorical != "infer" and f.name in categorical:
                texts.append(f.name)
            elif isinstance(f.dataType, (NumericType, BooleanType)):
                numeric.append(f.name)
            elif isinstance(f.dataType, StringType):
                if categorical == "infer":
                    texts.append(f.name)
                else:
                    raise ValueError(f"text column {f.name} must be listed as categorical")
        if categorical != "infer":
            missing = set(categorical) - set(df.columns)
            if missing:
                raise ValueError(f"no such columns: {sorted(missing)}")
        return cls(id, label, sensitive, tuple(numeric), tuple(texts))

    def without(self, *names: str) -> "FeatureSpec":
        return replace(
            self,
            numeric=tuple(c for c in self.numeric if c not in names),
            categorical=tuple(c for c in self.categorical if c not in names),
        )
