"""Error families of the engine."""


class EngineError(Exception):
    """All errors that a statement can end in."""


class ParseError(EngineError):
    pass


class ValueError_(EngineError):
    """A statement that is well formed but can't be carried out with these values, names or types."""


class InternalError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class SerializationError(EngineError):
    def __init__(self):
        super().__init__("Serialization failure, retry transaction")


class ReadOnlyError(EngineError):
    def __init__(self):
        super().__init__("Read-only transaction")


class AbortError(EngineError):
    def __init__(self):
        super().__init__("Operation aborted")
