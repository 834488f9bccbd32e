"""End-of-day quote analytics as plain Spark DataFrame functions.

``sources``    files and tables in, tables out
``functions``  column expressions
``operators``  DataFrame -> DataFrame building blocks (dedup, merge, EMA, quality)
``plans``      the daily load (bronze, silver, gold) and the serving queries
``streaming``  the same work on Structured Streaming
"""
