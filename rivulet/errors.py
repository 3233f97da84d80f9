"""The one error that scripts and plans raise."""


class FlowError(Exception):
    """A script that can't be read, planned or run; code, line and column say why and where."""

    def __init__(self, message: str, code: int = 1000, line: int | None = None, column: int | None = None):
        at = f" (line {line}, column {column})" if line is not None else ""
        super().__init__(f"[{code}] {message}{at}")
        self.code, self.line, self.column = code, line, column
