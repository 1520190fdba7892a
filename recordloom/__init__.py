"""Evidence-linked decision analytics over append-only conversation logs, on Spark DataFrames."""
