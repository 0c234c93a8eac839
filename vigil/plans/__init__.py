"""Query catalog: every operator id from the inventory as a runnable query
over the driver's tables, each with an independent SQL oracle.

``vigil.plans.registry.QUERIES`` maps id -> (spark, sf_dir) -> DataFrame and
``ORACLE`` maps id -> DuckDB SQL text.  Importing this package loads every
catalog module.
"""
