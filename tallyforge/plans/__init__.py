"""Registered queries and their SQL."""


def load():
    """The registry, with every plan module imported."""
    from tallyforge.plans import browse, extras, publish, registry, resolve, runs, scoring, streaming, tables, targets, web  # noqa: F401

    return registry
