"""What can go wrong with a request."""


class InvalidQuery(ValueError):
    pass


class InvalidWrite(ValueError):
    pass


class InvalidSchema(InvalidWrite):
    pass


class IdempotencyConflict(InvalidWrite):
    pass


class NotFound(LookupError):
    pass


class AlreadyExists(ValueError):
    pass


class Backpressure(RuntimeError):
    pass


class CasMismatch(RuntimeError):
    pass


class Corrupt(RuntimeError):
    pass
