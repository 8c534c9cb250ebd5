"""Hospital price-transparency analytics on PySpark.

Raw charge files of any supported layout become two tables, ``hospitals`` and
``medical_operations``; everything else is a query over those tables.  Every
operator is a function from DataFrames or Columns to DataFrames or Columns.
"""
