"""ledgerlight: labelled transaction and account analytics on Spark DataFrames."""
