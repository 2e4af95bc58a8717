"""The three credit tables: how each is prepared, and loading them by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.spec import FeatureSpec
from riskframe.operators import prep
from riskframe.sources.tables import write_prepared

# Codes and labels of the German credit table.
GERMAN_LABELS = {
    "CheckingAccount": {"A11": "< 0", "A12": "0 - 200", "A13": "> 200", "A14": "No"},
    "CreditHistory": {
        "A30": "No credits/all paid",
        "A31": "All paid",
        "A32": "Existing paid",
        "A33": "Delay in paying",
        "A34": "Critical account",
    },
    "Purpose": {
        "A40": "Car (new)",
        "A41": "Car (used)",
        "A42": "Furniture/equipment",
        "A43": "Radio/television",
        "A44": "Domestic appliances",
        "A45": "Repairs",
        "A46": "Education",
        "A47": "Vacation",
        "A48": "Retraining",
        "A49": "Business",
        "A410": "Others",
    },
    "SavingsAccount": {
        "A61": "< 100",
        "A62": "100 - 500",
        "A63": "500 - 1000",
        "A64": "> 1000",
        "A65": "Unknown/None",
    },
    "EmploymentSince": {
        "A71": "Unemployed",
        "A72": "< 1",
        "A73": "1 - 4",
        "A74": "4 - 7",
        "A75": "> 7",
    },
    "Gender": {"A91": "Male", "A92": "Female", "A93": "Male", "A94": "Male", "A95": "Female"},
    "OtherDebtors": {"A101": "No", "A102": "Co-applicant", "A103": "Guarantor"},
    "Property": {
        "A121": "Real estate",
        "A122": "Savings agreement/life insurance",
        "A123": "Car or other",
        "A124": "Unknown/None",
    },
    "OtherInstallmentPlans": {"A141": "Bank", "A142": "Stores", "A143": "No"},
    "Housing": {"A151": "Rent", "A152": "Own", "A153": "For free"},
    "Job": {
        "A171": "Unemployed",
        "A172": "Unskilled",
        "A173": "Skilled",
        "A174": "Highly skilled",
    },
    "Telephone": {"A191": 0, "A192": 1},
    "ForeignWorker": {"A201": 1, "A202": 0},
}

# Raw columns of the German credit table, in file order.
GERMAN_SCHEMA = (
    "CheckingAccount string, Duration double, CreditHistory string, Purpose string, "
    "CreditAmount double, SavingsAccount string, EmploymentSince string, "
    "InstallmentRate double, PersonalStatus string, OtherDebtors string, "
    "ResidenceSince double, Property string, Age double, OtherInstallmentPlans string, "
    "Housing string, ExistingCredits double, Job string, Dependents double, "
    "Telephone string, ForeignWorker string, DEFAULT int"
)

# Codes and labels of the Taiwan table.
TAIWAN_LABELS = {
    "SEX": {1: "Male", 2: "Female"},
    "EDUCATION": {
        -2: "Unknown",
        -1: "Unknown",
        0: "Unknown",
        1: "Graduate School",
        2: "University",
        3: "High School",
        4: "Others",
        5: "Unknown",
        6: "Unknown",
    },
    "MARRIAGE": {0: "Others", 1: "Married", 2: "Single", 3: "Others"},
}

# Categorical columns declared per table.
TAIWAN_CATEGORICAL = [
    "SEX",
    "EDUCATION",
    "MARRIAGE",
    "PAY_0",
    "PAY_2",
    "PAY_3",
    "PAY_4",
    "PAY_5",
    "PAY_6",
]
GERMAN_CATEGORICAL = list(GERMAN_LABELS)

# Home Credit columns that are dropped, and its label.
HOMECREDIT_DROP = ["SK_ID_CURR", "OCCUPATION_TYPE", "ORGANIZATION_TYPE"]
LABEL = "DEFAULT"


def prepare_german(raw: DataFrame) -> DataFrame:
    """Readable categories, the gender column, and 1 for a bad payer."""
    df = prep.recode_binary(raw, LABEL, 2)
    df = df.withColumn("Gender", F.col("PersonalStatus")).drop("PersonalStatus")
    for column, labels in GERMAN_LABELS.items():
        df = prep.recode(df, column, labels)
    return df


def prepare_taiwan(
    raw: DataFrame, header: Mapping[str, str] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """All columns as double, then the three coded columns as labels.

    ``header`` names the columns when the file's real header is its first data
    row; ``keep`` retains id columns that are dropped otherwise.
    """
    df = prep.promote_header(raw, header) if header else raw
    unwanted = [c for c in ("ID",) if c not in keep]
    df = prep.drop_and_rename(df, unwanted, {"default payment next month": LABEL})
    df = prep.cast_all(df)
    for column, labels in TAIWAN_LABELS.items():
        df = prep.recode(df, column, {float(code): label for code, label in labels.items()})
    return df


def prepare_homecredit(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the applicant number (unless kept) and two many-valued columns."""
    unwanted = [c for c in HOMECREDIT_DROP if c not in keep]
    return prep.drop_and_rename(raw, unwanted, {"TARGET": LABEL})


PREPARE = {
    "homecredit": prepare_homecredit,
    "taiwan": prepare_taiwan,
    "german": prepare_german,
}


@dataclass(frozen=True)
class Dataset:
    """A prepared table on storage and the roles of its columns."""

    path: str
    schema: str
    id: str
    label: str = LABEL
    sensitive: str | None = None
    categorical: str | tuple[str, ...] = "infer"
    format: str = "parquet"


class Registry:
    """Prepared tables by name."""

    def __init__(self, datasets: Mapping[str, Dataset] | None = None):
        self._datasets = dict(datasets or {})

    def register(self, name: str, dataset: Dataset) -> None:
        self._datasets[name] = dataset

    def store(self, name: str, df: DataFrame, path: str, id: str, **roles) -> Dataset:
        """Write a prepared table and remember where it is."""
        format = roles.get("format", "parquet")
        write_prepared(df, path, format)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        self._datasets[name] = Dataset(path=path, schema=ddl, id=id, **roles)
        return self._datasets[name]

    def load(self, spark: SparkSession, name: str) -> tuple[DataFrame, FeatureSpec]:
        if name not in self._datasets:
            known = ", ".join(sorted(self._datasets)) or "none"
            raise ValueError(f"unknown dataset {name!r}; registered: {known}")
        entry = self._datasets[name]
        reader = spark.read.schema(entry.schema)
        if entry.format == "csv":
            df = reader.option("header", True).csv(entry.path)
        else:
            df = reader.parquet(entry.path)
        chosen = entry.categorical
        spec = FeatureSpec.infer(
            df,
            id=entry.id,
            label=entry.label,
            sensitive=entry.sensitive,
            categorical=chosen if chosen == "infer" else list(chosen),
        )
        return df, spec
