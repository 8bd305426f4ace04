"""Record-linkage operators: pure functions from DataFrames to DataFrames, keyed by ids, never by position.

Names used throughout: s1 rows are the entities of the reference table (s1_idx), rec rows the records to link (rec_idx),
pairs or candidates have both.
"""
