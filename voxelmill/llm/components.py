"""Connected components, as the whole library has them."""

from ..components import components, local_labels

__all__ = ["components", "local_labels"]
