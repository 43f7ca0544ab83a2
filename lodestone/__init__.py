"""lodestone: a PySpark-native analytics engine built on DataFrames, SQL and Catalyst."""
