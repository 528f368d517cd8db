"""Importing this package registers every query."""

from importlib import import_module
from pkgutil import iter_modules

for _module in iter_modules(__path__):
    import_module(f"{__name__}.{_module.name}")
