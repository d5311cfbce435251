"""Merging the spans of two detectors, as expressions over two arrays of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garim.functions import spans as S
from garim.functions.labels import action

MODES = ("union", "intersection", "enrich_primary", "cross_validation", "role_split", "fallback_secondary")
#: Labels that a second detector decides in a role split.
DELEGATED = ("PERSON", "ADDRESS", "NATIONALITY", "EDUCATION", "MAJOR", "POSITION", "AGE", "HEIGHT", "WEIGHT", "DT_BIRTH")


def agree(a: Column, b: Column) -> Column:
    """Whether two spans have the same label and overlap."""
    return (a["label"] == b["label"]) & S.overlaps(a, b)


def merged(primary: Column, secondary: Column, mode: str, delegated: tuple[str, ...] = DELEGATED, policy: str = "STRICT") -> Column:
    """Resolved spans. Agreement means the same label and an overlap; it adds 0.05 of confidence, up to 1.
    Under cross validation what only the second detector found keeps 0.7 of its confidence. A fallback asks the second detector about
    the spans alone that `policy` leaves to REVIEW: one that it agrees with is raised, one where it found something else gives way to
    that, and one of which it knows nothing stays for a person. It adds nothing elsewhere, nor over spans that are settled."""
    raised = lambda s: s.withField("confidence", F.least(F.lit(1.0), s["confidence"] + 0.05))
    confirmed = F.transform(primary, lambda p: F.when(F.exists(secondary, lambda s: agree(p, s)), raised(p)).otherwise(p))
    if mode == "union":
        found = F.concat(primary, secondary)
    elif mode == "intersection":
        found = F.transform(F.filter(primary, lambda p: F.exists(secondary, lambda s: agree(p, s))), raised)
    elif mode == "enrich_primary":
        found = F.concat(confirmed, F.filter(secondary, lambda s: ~F.exists(primary, lambda p: S.overlaps(p, s))))
    elif mode == "cross_validation":
        alone = F.filter(secondary, lambda s: ~F.exists(primary, lambda p: agree(p, s)))
        found = F.concat(confirmed, F.transform(alone, lambda s: s.withField("confidence", s["confidence"] * 0.7)))
    elif mode == "role_split":
        found = F.concat(F.filter(primary, lambda p: ~p["label"].isin(*delegated)), F.filter(secondary, lambda s: s["label"].isin(*delegated)))
    elif mode == "fallback_secondary":
        asked = lambda p: action(p["risk_level"], p["confidence"], policy) == "REVIEW"
        settled = F.filter(primary, lambda p: ~asked(p))
        free = F.filter(secondary, lambda s: ~F.exists(settled, lambda p: S.overlaps(p, s)))

        def answered(p: Column) -> Column:
            other = F.filter(free, lambda s: S.overlaps(p, s))
            return F.when(F.exists(secondary, lambda s: agree(p, s)), F.array(raised(p))).when(F.size(other) > 0, other).otherwise(F.array(p))

        found = F.concat(settled, F.flatten(F.transform(F.filter(primary, asked), answered)))
    else:
        raise ValueError(f"unknown mode {mode}")
    return S.resolve(found)
