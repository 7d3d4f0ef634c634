"""Tessera: code-intelligence retrieval, graph and evaluation operators as Spark DataFrames."""
