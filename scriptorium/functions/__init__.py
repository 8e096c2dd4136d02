"""scriptorium: document-extraction analytics on DataFrames."""
