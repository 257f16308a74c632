from cohortry.sources.tables import Sources

__all__ = ["Sources"]
