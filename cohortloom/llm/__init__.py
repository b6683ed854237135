"""Training-data operators. Nothing else in the package imports this folder."""


def register() -> None:
    """Add the queries of this folder to the catalog."""
    from cohortloom.llm import queries, queries_native  # noqa: F401
