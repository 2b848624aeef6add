"""Cadastral analytics on Spark: spatial joins, fits, gates and nested-record tables as DataFrame operators."""
