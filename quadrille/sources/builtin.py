"""Built-in sources: the demo fixture, files, tables, and inline rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PanelError
from .base import Capabilities, DataSource, FieldInfo, LoadRequest
from .names import ENTITY, TIME, date_column, is_date

# Fixed values of the demo panel: entity, revenue in 2017, growth, sector, exchange, country.
DEMO = [
    ("AAA", 100.0, 0.10, "Tech", "NASDAQ", "USA"), ("BBB", 200.0, 0.05, "Tech", "NASDAQ", "USA"), ("CCC", 150.0, 0.08, "Tech", "NYSE", "USA"),
    ("DDD", 300.0, 0.02, "Energy", "NYSE", "CAN"), ("EEE", 250.0, -0.03, "Energy", "NYSE", "CAN"), ("FFF", 400.0, 0.04, "Financials", "NYSE", "GBR"),
]
YEARS = range(2017, 2025)
# Fixed values of the demo panel: each field as a multiple of revenue.
MULTIPLES = {
    "income": {"revenue": 1, "cogs": 0.55, "gross_profit": 0.45, "operating_income": 0.20, "net_income": 0.12, "interest_expense": 0.02, "income_tax_expense": 0.03, "income_before_tax": 0.15, "depreciation_amortization": 0.04, "ebitda": 0.24, "sga": 0.10},
    "balance": {
        "total_assets": 2, "current_assets": 0.8, "other_current_assets": 0.05, "current_liabilities": 0.5, "total_liabilities": 1.2, "total_debt": 0.7, "total_equity": 0.8, "retained_earnings": 0.4,
        "accounts_receivable": 0.15, "inventory": 0.10, "accounts_payable": 0.12, "net_fixed_assets": 0.9, "cash_and_equivalents": 0.25, "cash_and_short_term_investments": 0.30, "minority_interest": 0.02, "common_stock": 0.05, "goodwill": 0.20,
    },
    "cash": {"cfo": 0.15, "capex": 0.05, "free_cash_flow": 0.10, "cfi": -0.06, "cff": -0.04, "net_change_in_cash": 0.05, "dividends_paid": 0.03},
}


def demo_kinds() -> dict[str, str]:
    """The vocabulary of the demo panel."""
    kind = {"income": "flow", "balance": "stock", "cash": "flow"}
    out = {f"{space}.{name}": kind[space] for space, names in MULTIPLES.items() for name in names}
    out |= {"income.eps_diluted": "per_share", "income.weighted_average_shares_diluted": "stock", "income.weighted_average_shares": "stock"}
    return out | {"balance.long_term_debt": "stock", "cash.stock_issued": "flow", "price.adj_close": "price", "price.dividends": "per_share"}


def demo_rows() -> list[dict]:
    out = []
    for i, (entity, base, growth, sector, exchange, country) in enumerate(DEMO):
        for t, year in enumerate(YEARS):
            rev = base * (1 + growth) ** t
            row: dict = {ENTITY: entity, TIME: dt.datetime(year, 12, 31)}
            row |= {f"{space}.{name}": m * rev for space, names in MULTIPLES.items() for name, m in names.items()}
            row |= {"income.eps_diluted": 0.12 * rev / (10 + i), "income.weighted_average_shares_diluted": 10.0 + i, "income.weighted_average_shares": 9.5 + i}
            row |= {"balance.long_term_debt": 0.6 * rev * 0.98**t, "cash.stock_issued": None if entity == "AAA" else 0.0}
            row |= {"price.adj_close": 0.3 * rev + 5 * i, "price.dividends": 0.03 * rev / (10 + i)}
            row |= {"meta.sector": sector, "meta.exchange": exchange, "meta.market_cap": 3e6 * rev, "meta.is_active": True, "meta.country": country}
            if entity == "FFF":
                row["income.interest_expense"] = None
            out.append(row)
    return out


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A panel from dictionaries; a column's type is found over all rows, numbers are doubles."""
    columns = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {}
    for c in columns:
        seen = [r[c] for r in rows if r.get(c) is not None]
        if is_date(c) or c == TIME:
            kinds[c] = T.TimestampNTZType() if all(isinstance(v, dt.datetime) for v in seen) else T.StringType()
        elif seen and all(isinstance(v, bool) for v in seen):
            kinds[c] = T.BooleanType()
        else:
            kinds[c] = T.StringType() if any(isinstance(v, str) for v in seen) else T.DoubleType()
    cast = lambda c, v: v if v is None or not isinstance(kinds[c], T.DoubleType) else float(v)
    text = lambda c, v: str(v) if v is not None and isinstance(kinds[c], T.StringType) else cast(c, v)
    schema = T.StructType([T.StructField(c, kinds[c]) for c in columns])
    return finished(spark.createDataFrame([tuple(text(c, r.get(c)) for c in columns) for r in rows], schema))


def finished(df: DataFrame) -> DataFrame:
    """Index columns in place and in type; a time that cannot be read is null."""
    for c in (ENTITY, TIME):
        if c not in df.columns:
            raise PanelError("E-DATA", f"the data has no {c!r} column")
    if df.schema[TIME].dataType.simpleString() == "string":
        df = df.withColumn(TIME, F.try_to_timestamp(F.col(TIME)).cast("timestamp_ntz"))
    return df.withColumn(TIME, F.col(TIME).cast("timestamp_ntz")).withColumn(ENTITY, F.col(ENTITY).cast("string"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV by its suffix, as a panel."""
    if path.endswith(".csv"):
        return finished(spark.read.csv(path, header=True, inferSchema=True))
    return finished(spark.read.parquet(path))


class FixtureSource(DataSource):
    """The demo panel."""

    def load(self, request: LoadRequest) -> DataFrame:
        df = from_rows(self.spark, demo_rows())
        if request.entities is not None:
            df = df.filter(F.col(ENTITY).isin(list(request.entities)))
        return df.select(ENTITY, TIME, *[f"`{f}`" for f in sorted(request.fields) if f in df.columns])

    def available_fields(self, frequency: str | None = None) -> set[str]:
        return set(demo_rows()[0]) - {ENTITY, TIME}

    def capabilities(self) -> Capabilities:
        return Capabilities("annual", period_range=(YEARS[0], YEARS[-1]), provides_meta=True, provenance="demo", is_global=False)

    def entities(self) -> list[str]:
        return [d[0] for d in DEMO]


class FrameSource(DataSource):
    """A source over any DataFrame; subclasses say which. Options: frequency, entity_dim, bridge_field,
    aligns_on (the date column all fields align on), global."""

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def load(self, request: LoadRequest) -> DataFrame:
        df = self.frame()
        if request.entities is not None:
            df = df.filter(F.col(ENTITY).isin(list(request.entities)))
        dates = [c for c in df.columns if is_date(c)]
        return df.select(ENTITY, TIME, *[f"`{c}`" for c in [*sorted(f for f in request.fields if f in df.columns), *dates]])

    def available_fields(self, frequency: str | None = None) -> set[str]:
        return {c for c in self.frame().columns if c not in (ENTITY, TIME) and not is_date(c)}

    def capabilities(self) -> Capabilities:
        o = self.options
        return Capabilities(o.get("frequency", "annual"), tuple(o.get("frequencies", ())), entity_dim=o.get("entity_dim", ENTITY), bridge_field=o.get("bridge_field", ""), pit=bool(o.get("aligns_on")), is_global=o.get("global"))

    def describe_field(self, field: str) -> FieldInfo | None:
        return FieldInfo(field, aligns_on=self.options.get("aligns_on"))


class ParquetSource(FrameSource):
    """Files at options.path."""

    def frame(self) -> DataFrame:
        return read_file(self.spark, self.options["path"])


class TableSource(FrameSource):
    """A catalog table or view named options.table."""

    def frame(self) -> DataFrame:
        return finished(self.spark.table(self.options["table"]))


class RowsSource(FrameSource):
    """Inline options.rows, or options.frame for a DataFrame that exists already."""

    def frame(self) -> DataFrame:
        return finished(self.options["frame"]) if "frame" in self.options else from_rows(self.spark, self.options["rows"])


BUILTIN = {"fixture": FixtureSource, "parquet": ParquetSource, "spark_table": TableSource, "rows": RowsSource}
__all__ = ["BUILTIN", "FixtureSource", "FrameSource", "ParquetSource", "RowsSource", "TableSource", "date_column", "demo_kinds", "demo_rows", "finished", "from_rows", "read_file"]
