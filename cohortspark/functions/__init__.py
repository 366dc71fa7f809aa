"""Column-to-column functions: names, missing values, hashes, links, text similarity."""
