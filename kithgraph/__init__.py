"""Spark-native analytics over reputation networks, with training-data operators in :mod:`kithgraph.llm`."""
