"""Registered queries of the library's operators, each with its DuckDB SQL."""
