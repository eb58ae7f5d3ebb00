"""A versioned, ordered key-value engine whose every read is a Spark plan."""

VERSION = (0, 2, 0)
__version__ = ".".join(map(str, VERSION))
