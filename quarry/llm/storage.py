"""Tables that cut lineage, and when they are deleted: those of the library."""

from ..storage import delete, drop, scope, shared_dir, written

__all__ = ["delete", "drop", "scope", "shared_dir", "written"]
