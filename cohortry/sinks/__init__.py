"""Where results go."""

from cohortry.sinks.releases import FolderReleases, Release, Releases, TableReleases

__all__ = ["FolderReleases", "Release", "Releases", "TableReleases"]
