"""Registered queries: each name's DataFrame plan and, where SQL can express it, the same in SQL."""


def all_queries() -> dict:
    from tessera.plans import catalog, contracts, models, reviews  # noqa: F401  the others add their own to the catalog

    return catalog.QUERIES


def all_sql() -> dict[str, str]:
    all_queries()
    from pyspark.sql import SparkSession

    from tessera.operators.store import store_dir
    from tessera.plans import catalog, models

    root = store_dir(SparkSession.getActiveSession()).removeprefix("file://")
    return {name: sql.replace(models.STORE, root) for name, sql in catalog.ORACLE.items()}
