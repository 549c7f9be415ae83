"""Connected components, as the corpus operators import them."""

from drawlake.storage import components

__all__ = ["components"]
