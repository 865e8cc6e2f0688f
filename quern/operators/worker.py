"""Memory of Python workers: given back where work ends, as idle workers would hold it through what follows."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

#: Bytes of batches after which a worker gives back what it no longer uses.
EACH = 32 << 20


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def release() -> None:
    """Gives memory that nothing uses back to the system: Arrow's pool and the C library's free lists."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


_SPENT = [0]


def spent(nbytes: int) -> None:
    """Memory is given back for every ``EACH`` bytes that a worker has gone through."""
    _SPENT[0] += nbytes
    if _SPENT[0] >= EACH:
        _SPENT[0] = 0
        release()


def lean(work: Callable) -> Callable:
    """``work(batches)`` for ``mapInArrow``, which gives memory back as it goes and at its end."""
    def counted(batches):
        for batch in batches:
            size = batch.nbytes
            yield batch
            spent(size)

    def run(batches):
        try:
            yield from work(counted(batches))
        finally:
            release()
    return run


def leanly(work: Callable) -> Callable:
    """A function of Arrow columns that gives memory back as it goes."""
    @functools.wraps(work)
    def run(*columns):
        out = work(*columns)
        spent(out.nbytes + sum(c.nbytes for c in columns))
        return out
    return run
