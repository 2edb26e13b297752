"""causeway: causal rule graphs, evidence retrieval and answer scoring on Spark DataFrames."""
