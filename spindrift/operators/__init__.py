"""Search, quantisation, graph and evaluation operators over DataFrames."""
