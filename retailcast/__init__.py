"""Weekly retail forecasting on PySpark DataFrames."""
