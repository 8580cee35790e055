"""Registered queries by subject."""


def load() -> None:
    from wherry.queries import more, ranking, retrieval, text, upkeep  # noqa: F401
