"""The rules applied one request at a time, in plain Python."""

from __future__ import annotations

import hashlib

WS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STATUSES = {"draft", "probable_success", "confirmed_success", "failed"}


def lower(s):
    return "".join({"İ": "i", "Σ": "σ"}.get(ch, ch.lower()) for ch in s)


def norm(s):
    out, word = [], ""
    for ch in lower(s):
        if ch in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return " ".join(out + ([word] if word else []))


def tag_set(tags):
    return sorted({t for t in (lower(x).strip(WS) for x in tags or []) if t}, key=lambda t: t.encode())


def fingerprint(r):
    fields = ("title", "problem", "solution_text", "source_type", "source_name", "source_ref")
    lines = [norm(r[f]) for f in fields] + ["|".join(tag_set(r["tags"]))]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def clean(r):
    return {
        **r,
        **{f: r[f].strip(WS) for f in ("title", "problem", "solution_text")},
        "status": lower(r["status"]).strip(WS),
        "tags": tag_set(r["tags"]),
    }


def valid(r):
    return r["title"] != "" and r["solution_text"] != "" and r["status"] in STATUSES


def create(table, rows):
    """``table`` maps id to row; returns {seq: (outcome, id)}."""
    seen = {r["key"]: i for i, r in table.items()}
    top = max(table, default=0)
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        c = clean(r)
        if not valid(c):
            out[r["seq"]] = ("invalid", None)
            continue
        key = fingerprint(c)
        if key in seen:
            out[r["seq"]] = ("duplicate", seen[key])
            continue
        top += 1
        seen[key] = top
        table[top] = {**c, "key": key}
        out[r["seq"]] = ("created", top)
    return out


def update(table, rows):
    """The batch rule; see ``update_solutions``."""
    out, last = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        if valid(clean(r)):
            last[r["id"]] = r["seq"]
    held = {r["key"]: i for i, r in table.items()}
    taken = {}
    changes = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        c = clean(r)
        if not valid(c):
            out[r["seq"]] = ("invalid", None)
        elif r["id"] not in table:
            out[r["seq"]] = ("not_found", None)
        elif last[r["id"]] != r["seq"]:
            out[r["seq"]] = ("superseded", r["id"])
        else:
            row = {**table[r["id"]], **{f: c[f] for f in ("title", "problem", "solution_text", "status", "tags")}}
            key = fingerprint(row)
            owner = held.get(key, taken.get(key, r["id"]))
            if owner != r["id"]:
                out[r["seq"]] = ("duplicate", owner)
            else:
                taken[key] = r["id"]
                changes[r["id"]] = {**row, "key": key}
                out[r["seq"]] = ("updated", r["id"])
    table.update(changes)
    return out


def double_trigger(events, gap):
    """``events`` of one user in order; two state variables, as at a keyboard."""
    waiting, fired = None, []
    for at, event_id in events:
        if waiting is not None and at - waiting <= gap:
            fired.append(event_id)
            waiting = None
        else:
            waiting = at
    return fired


def held_presses(events):
    down, out = False, []
    for at, event_id, key, action in events:
        if key == "ctrl":
            down = action == "down"
        elif action == "down" and down:
            out.append((at, event_id))
    return out


def ring(hashes, size=3):
    recent, flags = [], []
    for h in hashes:
        flags.append(h not in recent)
        if flags[-1]:
            recent = [h, *recent][:size]
    return flags
