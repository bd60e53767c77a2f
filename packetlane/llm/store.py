"""Intermediate tables, as in the rest of the library."""

from packetlane.store import dropped, renamed, shared_folder, shuffles_freed, written

__all__ = ["dropped", "renamed", "shared_folder", "shuffles_freed", "written"]
