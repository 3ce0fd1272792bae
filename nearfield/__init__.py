"""Spark-native similarity search over dense vectors."""

from nearfield.database import Database
from nearfield.params import HnswBuildParams, HnswSearchParams

__version__ = "0.1.0"
VERSION_MAJOR, VERSION_MINOR, VERSION_PATCH = 0, 1, 0

__all__ = ["Database", "HnswBuildParams", "HnswSearchParams", "__version__"]
