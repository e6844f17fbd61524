"""Typed errors."""


class CytoloomError(Exception):
    """Any error that the package raises on purpose."""


class InputError(CytoloomError, ValueError):
    """An argument is wrong."""


class EmptySelection(InputError):
    """An action names no cell."""


class StructureError(CytoloomError, ValueError):
    """A table lacks what its kind needs."""


class ConfigError(CytoloomError, ValueError):
    """A configuration fails its checks."""


class StateError(CytoloomError, RuntimeError):
    """Objects do not belong together."""


class LedgerError(CytoloomError, ValueError):
    """A review ledger is inconsistent."""


class LockError(CytoloomError, RuntimeError):
    """Another process owns the resource."""


class IntegrityError(CytoloomError, RuntimeError):
    """Stored content differs from what was recorded."""


class PathError(CytoloomError, OSError):
    """A path is missing or unsafe."""


class NumberError(CytoloomError, ValueError):
    """A text isn't the number it should be."""


class DisabledRules(UserWarning):
    """Rules that need markers which are not callable."""


def require(condition: object, message: str, kind: type[CytoloomError] = InputError) -> None:
    if not condition:
        raise kind(message)


def check_text(value: object, what: str, limit: int) -> str:
    """Reviewer and reason texts: not blank, no tab or line feed, at most ``limit`` bytes."""
    require(isinstance(value, str) and value.strip() and not any(c in value for c in "\t\r\n") and len(value.encode()) <= limit, f"{what} must be one line of at most {limit} bytes")
    return value
