"""tessera: a code-index, retrieval and notebook analytics engine on PySpark DataFrames."""

__version__ = "0.1.0"
