"""tessera: spatial contact graphs, traversals and rank statistics as Spark plans."""

__version__ = "0.1.0"
