"""Graph and memory analytics on Spark DataFrames, with training-data operators in `tessera.llm`."""
