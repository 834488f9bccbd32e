"""File arrival, deduplication and running averages on Structured Streaming.

Every query runs with ``availableNow`` by default: it takes what has arrived
and ends, so it can replace a scheduled batch.  Progress lives in the query's
checkpoint folder, which has to be shared by the cluster.
"""
