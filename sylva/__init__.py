"""Sylva: ordered trees (XML documents and tables published as such) as node tables, queried with plain DataFrames."""
