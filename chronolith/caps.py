"""Thresholds of the store, and the admission rule for a write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .status import Status

MIB = 1 << 20


@dataclass(frozen=True)
class Caps:
    """Byte thresholds. busy_bytes = 0 turns backpressure off."""

    max_record_bytes: int = 64 * MIB
    wal_buffer_bytes: int = 256 * MIB
    flush_bytes: int = 4 * MIB
    busy_bytes: int = 192 * MIB
    #: About the size of a segment of the run.
    segment_bytes: int = 64 * MIB

    def ordered(self) -> bool:
        """Whether backpressure comes before the buffer limit, and that before one record can fill it."""
        room = self.wal_buffer_bytes >= 2 * self.max_record_bytes
        return room and (not self.busy_bytes or self.busy_bytes + self.max_record_bytes <= self.wal_buffer_bytes)

    def admit(self, record_bytes: int, buffered: int, in_flight: int = 0) -> Status:
        """What a write of record_bytes meets, the bytes already buffered and in flight given."""
        if record_bytes > self.max_record_bytes:
            return Status.RECORD_TOO_LARGE
        if buffered + record_bytes > self.wal_buffer_bytes:
            return Status.WAL_BUFFER_FULL
        if self.busy_bytes and buffered + in_flight + record_bytes > self.busy_bytes:
            return Status.BUSY
        return Status.OK

    def refusal(self, record_bytes: Column, buffered: Column, in_flight: Column | int = 0) -> Column:
        """admit for whole columns: the number of the status that each write meets."""
        busy = (buffered + in_flight + record_bytes > self.busy_bytes) & (self.busy_bytes > 0)
        met = F.when(record_bytes > self.max_record_bytes, int(Status.RECORD_TOO_LARGE))
        met = met.when(buffered + record_bytes > self.wal_buffer_bytes, int(Status.WAL_BUFFER_FULL)).when(busy, int(Status.BUSY))
        return met.otherwise(int(Status.OK))
