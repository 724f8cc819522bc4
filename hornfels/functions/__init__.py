"""Part of the library; see its modules."""
