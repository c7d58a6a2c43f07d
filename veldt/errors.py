"""Errors carry the layer that found them; their text is `layer: message`."""


class EngineError(Exception):
    layer = "execution"

    def __init__(self, message: str):
        super().__init__(f"{self.layer}: {message}")
        self.message = message


class ParseError(EngineError):
    layer = "parse"


class PlanError(EngineError):
    layer = "plan"


class ExecError(EngineError):
    layer = "execution"


class StorageError(EngineError):
    layer = "storage"


class BindError(EngineError):
    layer = "bind"


class UsageError(Exception):
    """Misuse of the API: a closed handle, a statement of the wrong sort, a finished transaction."""


class NoRows(UsageError):
    pass


class MultipleRows(UsageError):
    pass


def unsupported(layer: type[EngineError] = ParseError) -> EngineError:
    return layer("unsupported query form")


def mismatch() -> EngineError:
    return ExecError("type mismatch")


def constraint_violation(table: str, constraint: str, kind: str) -> EngineError:
    return ExecError(f"constraint violation: table={table} constraint={constraint} type={kind}")
