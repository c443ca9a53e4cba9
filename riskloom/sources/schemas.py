"""Explicit table schemas. Nothing is ever read with an inferred schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


BORROWERS = _schema(
    customer_id=StringType(),
    name=StringType(),
    age=IntegerType(),
    annual_income=DoubleType(),
    credit_score=IntegerType(),
    employment_type=StringType(),
    state=StringType(),
    years_employed=DoubleType(),
    existing_loans_count=IntegerType(),
)

LOANS = _schema(
    loan_id=StringType(),
    customer_id=StringType(),
    loan_purpose=StringType(),
    loan_amount=DoubleType(),
    outstanding_balance=DoubleType(),
    interest_rate=DoubleType(),
    tenure_months=IntegerType(),
    emi_amount=DoubleType(),
    disbursal_date=DateType(),
    loan_status=StringType(),
)

REPAYMENTS = _schema(
    repayment_id=StringType(),
    loan_id=StringType(),
    customer_id=StringType(),
    payment_date=DateType(),
    amount_paid=DoubleType(),
    emi_due=DoubleType(),
    days_late=IntegerType(),
    payment_month=IntegerType(),
)

PRICES = _schema(date=DateType(), symbol=StringType(), price=DoubleType())

SUMMARY_COLUMNS = [
    "Model",
    "RMSE",
    "MAE",
    "R2",
    "DirAcc",
    "CumReturn",
    "BnH",
    "Sharpe",
    "MaxDrawdown",
]


def assert_schema(df: DataFrame, schema: StructType, *, types: bool = True) -> DataFrame:
    """Raise unless ``df`` has every column of ``schema`` (and its type); return ``df``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType}"
        for f in schema.fields
        if f.name not in have or (types and have[f.name] != f.dataType)
    ]
    if wrong:
        raise ValueError("table does not fit its schema: " + "; ".join(wrong))
    return df
