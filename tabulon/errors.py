"""Errors raised by the engine."""


class EngineError(ValueError):
    """A request that cannot be answered: bad arguments, unusable columns or a model that cannot be fitted."""
