"""A subset of Sigma rules: selections of field: value (or list) maps, and a condition over them."""

from __future__ import annotations

import fnmatch
import re

from chronolith.streaming.rules import predicate


class SigmaError(ValueError):
    pass


def selection(body: dict | list):
    """All fields of a map must match (a list: any value); a list of maps: any."""
    if isinstance(body, list):
        return ("or", *(selection(b) for b in body))
    parts = []
    for key, value in body.items():
        if "|" in key:
            raise SigmaError(f"modifier in {key}")
        values = value if isinstance(value, list) else [value]
        parts.append(("in", key, values) if len(values) > 1 else ("eq", key, values[0]))
    if not parts:
        raise SigmaError("empty selection")
    return parts[0] if len(parts) == 1 else ("and", *parts)


def compile_rule(detection: dict):
    """A detection section to a rule of `predicate`. and binds tighter than or; not binds tightest; `1 of x*`, `all of x*`."""
    named = {k: selection(v) for k, v in detection.items() if k != "condition"}
    toks = re.findall(r"\(|\)|[\w*]+", detection["condition"])
    pos = 0

    def peek():
        return toks[pos].lower() if pos < len(toks) else None

    def take():
        nonlocal pos
        pos += 1
        return toks[pos - 1]

    def either():
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both():
        parts = [one()]
        while peek() == "and":
            take()
            parts.append(one())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def one():
        if peek() is None:
            raise SigmaError("the condition ends early")
        t = take()
        if t.lower() == "not":
            return ("not", one())
        if t == "(":
            r = either()
            if peek() != ")":
                raise SigmaError("missing )")
            take()
            return r
        if t.lower() in ("1", "all") and peek() == "of":
            take()
            want = take()
            found = [named[k] for k in sorted(named) if want == "them" or fnmatch.fnmatchcase(k, want)]
            if not found:
                raise SigmaError(f"nothing matches {want}")
            return found[0] if len(found) == 1 else (("and" if t.lower() == "all" else "or"), *found)
        if t not in named:
            raise SigmaError(f"unknown selection {t}")
        return named[t]

    rule = either()
    if peek() is not None:
        raise SigmaError(f"unexpected {peek()}")
    return rule


def column(detection: dict):
    return predicate(compile_rule(detection))
