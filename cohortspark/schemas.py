"""Declared schemas; what is read is brought to them."""

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)

QUALIFIED = T.StructType(
    RAW.fields + [T.StructField("Revenue", T.DoubleType()), T.StructField("IsCancellation", T.BooleanType())]
)

FEATURES = T.StructType(
    [
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Recency", T.IntegerType()),
        T.StructField("Frequency", T.LongType()),
        T.StructField("Monetary", T.DoubleType()),
        T.StructField("AvgOrderValue", T.DoubleType()),
        T.StructField("UniqueProducts", T.LongType()),
        T.StructField("TotalItems", T.LongType()),
        T.StructField("ActiveMonths", T.LongType()),
        T.StructField("TenureDays", T.IntegerType()),
        T.StructField("PurchaseSpanDays", T.IntegerType()),
        T.StructField("Country", T.StringType()),
        T.StructField("R", T.IntegerType()),
        T.StructField("F", T.IntegerType()),
        T.StructField("M", T.IntegerType()),
        T.StructField("RFM_Score", T.IntegerType()),
        T.StructField("RFM_Segment", T.StringType()),
        T.StructField("Churn_90D", T.IntegerType()),
    ]
)
