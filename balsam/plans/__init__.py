"""Registered plans: one callable (spark, sf_dir) -> DataFrame per inventory item,
and the DuckDB SQL that checks it."""
