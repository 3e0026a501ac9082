class QueryError(ValueError):
    """A request that cannot be answered as it is written."""


class MappingError(ValueError):
    """An index configuration that is not valid."""
