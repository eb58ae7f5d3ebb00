"""The closed set of outcomes, as an enum and as exceptions."""

from __future__ import annotations

from enum import IntEnum


class Status(IntEnum):
    OK = 0
    NOT_FOUND = 1
    RECORD_TOO_LARGE = 2
    WAL_BUFFER_FULL = 3
    IO_ERROR = 4
    DISK_FULL = 5
    CORRUPTION = 6
    KILLED = 7
    INVALID_ARGUMENT = 8
    BUSY = 9
    INTERNAL = 100
    BUFFER_TOO_SMALL = 101


def status_name(code: int) -> str:
    """The name of a code; an unknown code has the name UNKNOWN."""
    try:
        return Status(code).name
    except ValueError:
        return "UNKNOWN"


class StoreError(Exception):
    """An operation that did not take effect, with its status."""

    def __init__(self, status: Status, message: str = ""):
        if status == Status.OK:
            raise ValueError("an error needs a status other than OK")
        super().__init__(f"{status.name}: {message}" if message else status.name)
        self.status = status
