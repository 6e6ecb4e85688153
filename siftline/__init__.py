"""siftline: dataset curation and detection analytics as Spark DataFrames."""
