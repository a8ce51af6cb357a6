"""Spark engine for integrating, matching and presenting venue ranking catalogs."""

from __future__ import annotations

import os
from pathlib import Path


def reach(spark) -> None:
    """Let Python workers that share this file system import the package from here.

    Where it is installed, or shipped with ``--py-files``, this changes nothing.
    """
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
