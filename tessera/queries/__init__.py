"""Importing this package fills tessera.catalogue."""

from tessera.queries import catalog, changes, content, evaluation, graphs, index_store, maintenance, retrieval, understanding, values  # noqa: F401
