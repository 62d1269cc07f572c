"""Collection operators over DataFrames: pairs, reductions, ordered collections, grids, domains, steps, terms, series."""
