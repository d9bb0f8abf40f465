"""lexloom: document analytics (segmentation, classification, retrieval, reporting) as Spark DataFrames."""
