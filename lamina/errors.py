"""Errors of the engine."""


class LaminaError(Exception):
    """Any error of this engine."""


class SyntaxProblem(LaminaError):
    """The text is no statement of the dialect; says where."""

    def __init__(self, message: str, text: str = "", at: int = 0):
        line, column = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class SchemaProblem(LaminaError):
    """A type, table or user-defined type is not valid."""


class QueryProblem(LaminaError):
    """The statement is well formed but cannot be run: unknown names, wrong arguments."""
