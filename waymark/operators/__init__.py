"""DataFrame to DataFrame operators.

Nearly all are lazy plans of built-in functions. Those that need a number or an order of all rows first run a job for it: `positions`
and what uses it write the rows out, draws with replacement and mixes count them, codebook training sums vectors by code. Windows
over one partition see a row a range, a bucket or a prefix count, never the rows. Python runs in Arrow batches: codes, retrieval.
"""
