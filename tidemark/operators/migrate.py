"""Folding the generations of an index into the newest one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.operators.merge import State, count_live_tomb, fold
from tidemark.operators.verify import Rejected, verify_state
from tidemark.sources.state import Read, Status


def sweep(generations: list[str], read: Callable[[str], Read], dry_run: bool) -> dict[str, Read]:
    """Reads every generation, newest first. A failed read stops a real run; a dry run goes on."""
    found: dict[str, Read] = {}
    for g in generations:
        try:
            found[g] = read(g)
        except Exception as e:  # noqa: BLE001  a dry run reports whatever a store raises
            if not dry_run:
                raise Rejected(f"{g}: {e}") from e
            found[g] = Read(Status.FAILED, None)
    return found


def report(found: dict[str, Read]) -> dict[str, tuple[str, int, int]]:
    """Status, live and removed entries of each generation; only tombstones still count as a state."""
    out = {}
    for g, r in found.items():
        row = count_live_tomb(r.state.records).first() if r.state else {"live": 0, "tombstones": 0}
        out[g] = (r.status.value, row["live"], row["tombstones"])
    return out


def migrate(generations: list[str], read: Callable[[str], Read], write: Callable[[State], None], readback: Callable[[], DataFrame], root: bytes, slug: str, acks: set[str] = frozenset(), dry_run: bool = False) -> dict:
    """Sweep, fold all states (not only the newest), verify, write once, read back, then judge acknowledgements.

    Generations that are absent must be acknowledged by name. A dry run writes nothing and fails
    on failed reads too.
    """
    found = sweep(generations, read, dry_run)
    states = [r.state for r in found.values() if r.state is not None]
    missing = sorted(g for g, r in found.items() if r.status in (Status.UNFINDABLE, Status.EMPTY) and g not in acks)
    failed = sorted(g for g, r in found.items() if r.status is Status.FAILED)
    result = {"report": report(found), "missing": missing, "failed": failed, "written": False}
    folded = fold(states) if states else None
    if folded is not None:
        reason = verify_state(folded, root, slug)
        if reason:
            raise Rejected(reason)
        if not dry_run:
            write(folded)
            result["written"] = True
            row = count_live_tomb(readback()).first()
            result["readback"] = (row["live"], row["tombstones"])
    if missing or (dry_run and failed):
        raise Rejected(f"not acknowledged: {missing}; failed: {failed}")
    return result
