"""Weftline: analytics over captured web pages, as Spark DataFrame transformations."""
