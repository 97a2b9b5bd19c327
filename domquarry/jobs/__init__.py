"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` with an
equivalent DuckDB SQL oracle (see ``__spark_entry__.py``)."""
