"""The errors that the engine raises."""


class QuadtideError(Exception):
    """Base of all errors of this package."""


class QueryParseError(QuadtideError):
    """The query text can't be read."""


class UnsupportedError(QueryParseError):
    """The query is well formed but asks for something the engine lacks."""


class ExecutionError(QuadtideError):
    """A query failed while it ran."""


class StorageError(QuadtideError):
    """The quad log can't be read or written."""


class LiveError(QuadtideError):
    """A live stream was used wrongly."""


class ReplayError(QuadtideError):
    """A replay failed."""


class RegistryError(QuadtideError):
    """A query's registration failed."""


class QueryNotFound(RegistryError):
    pass


class QueryExists(RegistryError):
    pass


class TooManyQueries(RegistryError):
    pass


class InvalidState(RegistryError):
    """The query is running and must not be, or the other way round."""
