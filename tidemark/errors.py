"""Errors of the engine; every one is an EngineError."""


class EngineError(Exception):
    pass


class ParseError(EngineError):
    """Text that is no statement of the dialect."""


class AnalysisError(EngineError):
    """A statement that names what is not there or combines what does not fit."""


class ColumnNotFound(AnalysisError):
    pass


class AmbiguousColumn(AnalysisError):
    pass


class ColumnNotGrouped(AnalysisError):
    pass


class ColumnCannotBeNull(AnalysisError):
    pass


class TableNotFound(AnalysisError):
    pass


class TableExists(AnalysisError):
    pass


class IndexExists(AnalysisError):
    pass


class UniqueViolation(EngineError):
    pass


class TransactionAborted(EngineError):
    """A commit that a concurrent one has overtaken."""


class NotInTransaction(EngineError):
    pass


class CommandError(EngineError):
    pass


class OptionError(EngineError):
    pass
