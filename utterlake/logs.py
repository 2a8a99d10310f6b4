"""Logging of the library: one configuration, and unhandled errors on record."""

from __future__ import annotations

import logging
import sys


def configure(level: int = logging.INFO, file: str | None = None) -> logging.Logger:
    """Log to standard error, and to ``file`` if given; an unhandled exception is logged before it is shown."""
    logger = logging.getLogger("utterlake")
    logger.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    for handler in [logging.StreamHandler()] + ([logging.FileHandler(file, encoding="utf-8")] if file else []):
        handler.setFormatter(form)
        logger.addHandler(handler)
    shown = sys.excepthook

    def hook(kind, error, trace):
        if not issubclass(kind, KeyboardInterrupt):
            logger.critical("unhandled error", exc_info=(kind, error, trace))
        shown(kind, error, trace)

    sys.excepthook = hook
    return logger
