"""The generated demo tables: employees(n), departments(10) and orders(n / 2), the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPARTMENTS = ["Engineering", "Sales", "HR", "Marketing", "Finance", "Operations", "Legal", "Support", "Research", "Design"]
PLACES = ["North", "South", "East", "West"]
GOODS = ["Laptop", "Phone", "Tablet", "Monitor", "Keyboard", "Mouse", "Desk", "Chair"]


def _pick(values: list[str], salt: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _between(low: int, high: int, salt: str):
    return (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1))).cast("long")


def employees(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select("id", F.concat(F.lit("Employee_"), "id").alias("name"), _pick(DEPARTMENTS, "dept").alias("dept"), _between(30_000, 149_999, "salary").alias("salary"), _between(22, 64, "age").alias("age"))


def departments(spark: SparkSession) -> DataFrame:
    rows = spark.range(len(DEPARTMENTS))
    return rows.select(F.element_at(F.array(*[F.lit(d) for d in DEPARTMENTS]), (F.col("id") + 1).cast("int")).alias("dept_name"), _between(100_000, 999_999, "budget").alias("budget"), _pick(PLACES, "place").alias("location"))


def orders(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n // 2 + 1).select(F.col("id").alias("order_id"), _between(1, 1000, "employee").alias("employee_id"), (_between(1000, 500_000, "amount") / 100).alias("amount"), _pick(GOODS, "product").alias("product"))
