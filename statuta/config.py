"""Settings that are checked before use: chunk sizes, text limits of embeddings, timing records."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

log = logging.getLogger("statuta")


@dataclass(frozen=True)
class Chunking:
    """Sizes in characters. Those of whole pieces, overlaps and levels."""

    most: int = 1_500
    least: int = 50
    overlap: int = 100
    verse: int = 1_200
    letter: int = 800
    sentence: int = 1_500

    def problems(self) -> list[str]:
        """What is wrong with these sizes; empty if nothing."""
        out = [f"{n} must be positive" for n in ("most", "least", "verse", "letter", "sentence") if getattr(self, n) <= 0]
        if self.least >= self.most:
            out.append("least must be smaller than most")
        if self.overlap < 0 or 2 * self.overlap >= self.most:
            out.append("overlap must be at least 0 and smaller than half of most")
        out += [f"{n} must not be larger than most" for n in ("verse", "letter", "sentence") if getattr(self, n) > self.most]
        return out


@contextmanager
def timed(operation: str, **more: object) -> Iterator[dict]:
    """Logs one JSON record with the duration of a block, also when it fails; the caller may add fields to it."""
    record: dict = {"operation": operation, **more}
    began = time.perf_counter()
    try:
        yield record
        record["status"] = "done"
    except Exception as error:
        record |= {"status": "failed", "error": f"{type(error).__name__}: {error}"}
        raise
    finally:
        record["duration_ms"] = round((time.perf_counter() - began) * 1_000, 3)
        log.info(json.dumps(record, ensure_ascii=False, default=str))
