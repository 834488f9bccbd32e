"""Files and tables in, tables out."""
