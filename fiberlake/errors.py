"""Errors raised on the driver, from metadata, before any task runs."""


class FiberlakeError(Exception):
    pass


class ParameterError(FiberlakeError, ValueError):
    pass


class CoordError(FiberlakeError, ValueError):
    pass


class PatchDimError(FiberlakeError, ValueError):
    pass


class UnitError(FiberlakeError, ValueError):
    pass


class ChunkError(FiberlakeError, ValueError):
    pass


class UnknownFormatError(FiberlakeError, ValueError):
    pass
