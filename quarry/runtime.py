"""What a process sets up around the engine: seeds, logs, and the client that the environment names."""

from __future__ import annotations

import logging
import os
import random
from logging.handlers import RotatingFileHandler

from .operators import clients
from .plans import Pipeline


def seed(n: int) -> None:
    """Seeds the random numbers of Python, numpy and, if it is there, torch in this process. Nothing in the engine's results depends on them."""
    import numpy as np

    random.seed(n)
    np.random.seed(n % 2**32)
    try:
        import torch
    except ImportError:
        return
    torch.manual_seed(n)


def log_to(path: str | None = None, level: int = logging.INFO, max_bytes: int = 10 << 20, keep: int = 3) -> logging.Logger:
    """The engine's log on standard error, and in a file that is rolled over if a path is given. Handlers of an earlier call are replaced."""
    log = logging.getLogger("quarry")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(level)
    for h in [logging.StreamHandler(), *([RotatingFileHandler(path, maxBytes=max_bytes, backupCount=keep)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


def from_environment() -> Pipeline:
    """QUARRY_CLIENT: heuristic (the default), remote (with QUARRY_URL, QUARRY_MODEL, QUARRY_KEY), local or engine (with QUARRY_MODEL)."""
    kind, model = os.environ.get("QUARRY_CLIENT", "heuristic"), os.environ.get("QUARRY_MODEL", "")
    url, key = os.environ.get("QUARRY_URL", ""), os.environ.get("QUARRY_KEY")
    made = {
        "heuristic": clients.HeuristicClient,
        "remote": lambda: clients.RemoteClient(url, model, key),
        "local": lambda: clients.LocalModelClient(model),
        "engine": lambda: clients.BatchEngineClient(model),
    }
    if kind not in made:
        raise ValueError(f"QUARRY_CLIENT: {kind} is none of {', '.join(made)}")
    return Pipeline.from_config(factory=made[kind])
