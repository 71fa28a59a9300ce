"""Settings of the library; one object, changed in place."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass
class Config:
    """``cache_dir`` is a path that Spark reads and writes; on a cluster it must be a shared one."""

    cache_dir: str = field(default_factory=lambda: os.environ.get("QUANTLOOM_CACHE_DIR", os.path.join(os.path.expanduser("~"), ".quantloom", "cache")))
    cache_enabled: bool = True
    default_backend: str = "spark"


config = Config()
