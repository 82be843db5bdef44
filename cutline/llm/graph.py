"""Connected components, as the library finds them."""

from cutline.operators.components import components, components_of_few

__all__ = ["components", "components_of_few"]
