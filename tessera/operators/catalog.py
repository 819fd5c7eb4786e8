"""The modules that hold queries of the engine's own operators."""

from tessera.operators import catalog_extract, catalog_find, catalog_fold, catalog_graph, catalog_incremental, catalog_notes, catalog_resolve, catalog_text

MODULES = [catalog_find, catalog_graph, catalog_resolve, catalog_fold, catalog_notes, catalog_incremental, catalog_text, catalog_extract]
