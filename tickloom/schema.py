"""Row types shared by the readers and operators, and the session settings they rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKET_ZONE = "America/New_York"

PRICE_COLUMNS = ["open", "high", "low", "close"]
BAR_COLUMNS = ["symbol", "ts", *PRICE_COLUMNS, "volume"]


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


BAR = _struct(
    symbol=T.StringType(), ts=T.TimestampType(), open=T.DoubleType(), high=T.DoubleType(),
    low=T.DoubleType(), close=T.DoubleType(), volume=T.DoubleType(),
)

STRATEGIES = _struct(
    id=T.LongType(), name=T.StringType(), time_frame=T.IntegerType(), symbol=T.StringType(),
    order_type=T.StringType(), lookback_days=T.IntegerType(), extended_hours=T.IntegerType(),
    active=T.IntegerType(), created_at=T.TimestampType(), updated_at=T.TimestampType(),
)

POSITIONS = _struct(
    id=T.LongType(), strategy_id=T.LongType(), order_id=T.StringType(), quantity=T.DoubleType(),
    entry_price=T.DoubleType(), opened_at=T.TimestampType(),
)

TRADE_HISTORY = _struct(
    id=T.LongType(), strategy_id=T.LongType(), quantity=T.DoubleType(), price=T.DoubleType(),
    side=T.StringType(), date=T.TimestampType(),
)

ORDER_STATUS = _struct(
    order_id=T.StringType(), status=T.StringType(), filled_quantity=T.DoubleType(),
    entered_time=T.TimestampType(),
)

REGISTRY = {
    "day_trading_strategies": STRATEGIES,
    "active_positions": POSITIONS,
    "trade_history": TRADE_HISTORY,
}


def session(app: str = "tickloom", **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC clock, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_columns(df: DataFrame, columns, what: str = "input") -> None:
    """Name check on the analyzed schema; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")


def time_columns(df: DataFrame) -> list[str]:
    """The order of a series' rows: time, then the number ``seq`` of their arrival where the frame has one.

    Rows of equal time and no ``seq`` have no defined order.
    """
    return ["ts", "seq"] if "seq" in df.columns else ["ts"]


def time_key(df: DataFrame) -> Column:
    """``time_columns`` as one value, for first and last rows in aggregations; a null ``seq`` comes first."""
    columns = time_columns(df)
    return F.col("ts") if columns == ["ts"] else F.struct(*columns)


def series_keys(df: DataFrame) -> list[str]:
    """The columns that identify one series: strategy (when there is one) and symbol."""
    return [c for c in ("strategy_id", "symbol") if c in df.columns]
