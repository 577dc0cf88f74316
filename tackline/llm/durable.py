"""Cutting lineage, as :mod:`tackline.durable` does it for the whole library."""

from tackline.durable import checkpointed, new_table, shared_folder, written

__all__ = ["checkpointed", "new_table", "shared_folder", "written"]
