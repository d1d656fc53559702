"""Reading delimited text and Spark tables; writing data, reports and the analysis catalogue."""
