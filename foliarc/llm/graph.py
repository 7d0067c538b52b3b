"""Connected components, which the library's own operators use as well."""

from foliarc.operators.components import connected_components, smallest_reached

__all__ = ["connected_components", "smallest_reached"]
