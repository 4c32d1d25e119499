"""Raw text and landed Parquet sources."""
