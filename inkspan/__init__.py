"""inkspan: a document-analytics engine on PySpark DataFrames."""
