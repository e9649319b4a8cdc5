"""Column expressions: plain builders over pyspark.sql.functions."""
