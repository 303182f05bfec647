"""Registered queries, grouped by area."""


def catalogue():
    import importlib
    import pkgutil

    from spectraloom.plans import base

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
    return base.CATALOGUE
