"""Data model: the four input tables, their types and the action names.

Timestamps are TIMESTAMP_NTZ (wall-clock time without a zone), so dates and
hours taken from them do not depend on the session time zone.  Money is
DECIMAL(12,2); every sum and ratio stays decimal inside the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Action names used in the event logs.
CREATE_ORDER = "create_order"
CANCEL_ORDER = "cancel_order"
ACCEPT_ORDER = "accept_order"
DELIVER_ORDER = "deliver_order"

PRICE_TYPE = T.DecimalType(12, 2)

USER_ACTIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
    ]
)

COURIER_ACTIONS = T.StructType(
    [
        T.StructField("courier_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("creation_time", T.TimestampNTZType()),
        T.StructField("product_ids", T.ArrayType(T.LongType())),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", PRICE_TYPE),
    ]
)

CAMPAIGN_MEMBERS = T.StructType(
    [
        T.StructField("ads_campaign", T.IntegerType()),
        T.StructField("user_id", T.LongType()),
    ]
)

SCHEMAS = {
    "user_actions": USER_ACTIONS,
    "courier_actions": COURIER_ACTIONS,
    "orders": ORDERS,
    "products": PRODUCTS,
}


class SchemaError(ValueError):
    pass


def conform(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Select the schema's columns in order, casting where types differ.

    Missing columns raise ``SchemaError``; extra columns are dropped, so the
    scan reads only what the model needs (column pruning reaches parquet).
    Timestamps with a zone are converted to wall-clock NTZ values.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in present]
    if missing:
        raise SchemaError(f"{table}: missing columns {missing}; has {sorted(present)}")
    cols = []
    for field in schema.fields:
        col = df[field.name]
        if present[field.name] != field.dataType:
            col = col.cast(field.dataType)
        cols.append(col.alias(field.name))
    return df.select(*cols)
