"""A campaign of daily chunks: resumed where it stopped, guarded by free space, ended by the first failure."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from pathlib import Path


def run_campaign(root: str, days: list[str], chunk: Callable[[str], dict], least_free_gb: float = 20, expected_warnings: frozenset[str] = frozenset(), free_gb: Callable[[str], float] | None = None) -> dict:
    """Runs ``chunk`` for each day that has no manifest yet and writes one.

    A chunk returns a dictionary, in it ``warnings``. Warnings that are not expected, an
    exception, or too little space stop the campaign; what is done stays done.
    """
    at = Path(root)
    at.mkdir(parents=True, exist_ok=True)
    free = free_gb or (lambda p: shutil.disk_usage(p).free / 1e9)
    done, skipped = [], []
    for day in days:
        manifest = at / f"{day}.json"
        if manifest.exists():
            skipped.append(day)
            continue
        if free(root) < least_free_gb:
            return {"done": done, "skipped": skipped, "stopped": f"{day}: less than {least_free_gb} GB free"}
        try:
            result = chunk(day)
        except Exception as e:
            return {"done": done, "skipped": skipped, "stopped": f"{day}: {e}"}
        odd = set(result.get("warnings", ())) - expected_warnings
        if odd:
            return {"done": done, "skipped": skipped, "stopped": f"{day}: {', '.join(sorted(odd))}"}
        part = manifest.with_suffix(".part")
        part.write_text(json.dumps(result, sort_keys=True, default=str))
        part.rename(manifest)
        done.append(day)
    return {"done": done, "skipped": skipped, "stopped": None}
