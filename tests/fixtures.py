"""Judgments with known verdicts: nine criteria, two judges."""

from __future__ import annotations

PATTERNS = {
    "PASS": [("Yes", "Yes")] * 8 + [("No", "No")],
    "FAIL": [("Yes", "Yes")] * 4 + [("No", "No")] * 5,
    "DISAGREE": [("Yes", "No")] * 4 + [("Yes", "Yes")] * 5,
}


def votes(counts: dict[str, int], qa_type: str = "type3") -> list[tuple]:
    rows, root = [], 0
    for verdict, n in counts.items():
        for _ in range(n):
            root += 1
            for c, pair in enumerate(PATTERNS[verdict], 1):
                rows += [(qa_type, "b1", "reg", root, c, judge, vote) for judge, vote in zip(("j1", "j2"), pair, strict=True)]
    return rows


SCHEMA = "QA_Type string, Batch string, Seed_Type string, Root_ID long, Criterion_No int, Judge string, Verdict string"
