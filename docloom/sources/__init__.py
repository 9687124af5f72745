from docloom.sources.tables import table

__all__ = ["table"]
