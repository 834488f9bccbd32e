"""The daily load and the serving queries, composed from the operators."""
