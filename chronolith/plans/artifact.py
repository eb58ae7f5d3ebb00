"""The record of a differential run: what was submitted, what was promised and what came back, as JSON.

Five sections, all needed. Reading refuses a record with a fault and names it; it never repairs one.
"""

from __future__ import annotations

import json

SECTIONS = ("provenance", "submission", "watermark", "recovered", "verdict")
KINDS = ("S", "D", "R", "sync", "take", "release")
VERDICTS = ("pass", "violation", "characterization", "inconclusive", "void")


class ArtifactFault(ValueError):
    pass


def _text(b: bytes | None) -> str | None:
    return None if b is None else b.hex()


def encode(seed: int, steps: list[tuple], watermark: int, recovered: dict[bytes, bytes], verdict: str) -> str:
    """steps: ("write", seq, ops) and ("sync" | "take" | "release",) in order."""
    submission = []
    for step in steps:
        if step[0] == "write":
            submission += [{"kind": kind, "seq": step[1], "k": _text(k), "v": _text(v), "lo": _text(lo), "hi": _text(hi)} for kind, k, v, lo, hi in step[2]]
        else:
            submission.append({"kind": step[0]})
    body = {"provenance": {"seed": seed, "format": 1}, "submission": submission, "watermark": watermark, "recovered": {k.hex(): v.hex() for k, v in sorted(recovered.items())}, "verdict": verdict}
    return json.dumps(body, indent=0, sort_keys=True)


def faults(text: str) -> list[str]:
    """What is wrong with a record; empty if it is sound."""
    try:
        a = json.loads(text)
    except ValueError:
        return ["not JSON"]
    if not isinstance(a, dict):
        return ["not an object"]
    found = [f"no {s}" for s in SECTIONS if s not in a] + [f"unknown section {s}" for s in a if s not in SECTIONS]
    if found:
        return found
    if not isinstance(a["provenance"], dict) or a["provenance"].get("format") != 1:
        found.append("unknown format")
    if not isinstance(a["watermark"], int) or a["watermark"] < 0:
        found.append("watermark is no sequence")
    if a["verdict"] not in VERDICTS:
        found.append(f"unknown verdict {a['verdict']}")
    top = last = 0
    for i, op in enumerate(a["submission"]):
        kind = op.get("kind")
        if kind not in KINDS:
            found.append(f"step {i}: unknown kind {kind}")
            continue
        if kind in ("S", "D", "R"):
            seq = op.get("seq")
            if not isinstance(seq, int) or seq < max(1, last):
                found.append(f"step {i}: sequence {seq} after {last}")
            else:
                last = top = seq
            if kind != "R" and op.get("k") is None:
                found.append(f"step {i}: no key")
            if (kind == "S") != (op.get("v") is not None):
                found.append(f"step {i}: a value that should {'be' if kind == 'S' else 'not be'} there")
        for part in ("k", "v", "lo", "hi"):
            try:
                bytes.fromhex(op.get(part) or "")
            except ValueError:
                found.append(f"step {i}: {part} is no hex")
    if isinstance(a["watermark"], int) and a["watermark"] > top:
        found.append(f"watermark {a['watermark']} beyond the last sequence {top}")
    return found


def decode(text: str) -> dict:
    """The record, bytes restored: submission as (seq, ops) batches."""
    if bad := faults(text):
        raise ArtifactFault("; ".join(bad))
    a = json.loads(text)
    raw = lambda x: None if x is None else bytes.fromhex(x)
    batches: dict[int, list] = {}
    for op in a["submission"]:
        if "seq" in op:
            batches.setdefault(op["seq"], []).append((op["kind"], *(raw(op[p]) for p in ("k", "v", "lo", "hi"))))
    return {**a, "submission": sorted(batches.items()), "recovered": {bytes.fromhex(k): bytes.fromhex(v) for k, v in a["recovered"].items()}}
