"""The supplied test tables as store data, the registered queries, and their SQL oracles."""
