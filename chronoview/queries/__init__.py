"""All queries of the package; importing a module registers its own."""

from . import cleansing, joining, ranking, scoring, stores, texts  # noqa: F401
