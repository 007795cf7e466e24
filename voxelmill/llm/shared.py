"""Tables between jobs, as the whole library has them."""

from ..shared import dropped, fresh_path, shared_folder, stored

__all__ = ["dropped", "fresh_path", "shared_folder", "stored"]
