"""The query catalogue. `load()` imports every module once and returns the registry."""
import importlib
import pkgutil

from wiresift.catalog import registry


def load():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
    return registry
