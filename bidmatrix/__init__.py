"""Vendor-quote comparison on Spark: every operator is DataFrame in, DataFrame out,
and answers for all sessions at once unless the caller filters to one."""
