"""Connected components: those of the library's own operators."""

from featlake.operators.graph import connected_components

__all__ = ["connected_components"]
