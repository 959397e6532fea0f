"""Texts from result rows, for readers: small tables and the result of one input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of result tables, each under its heading; a table of more than `most` rows says how many it leaves out."""
    out = [f"# {title}"]
    for name, rows in tables.items():
        found = rows.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
        out += ["| " + " | ".join(_cell(v) for v in r) + " |" for r in found[:most]]
        if len(found) > most:
            out += ["", f"Only the first {most} of {rows.count()} rows."]
    return "\n".join(out) + "\n"


def result_text(results: list[dict]) -> str:
    """All models' results for one input, as `api.score_all` gives them, best first."""
    if not results or not any(r["valid"] for r in results):
        return "The input is invalid.\n"
    good = [r for r in results if r["valid"]]
    likely = [r["category"] for r in good if r["role"] == "product" and r["score"] >= r["threshold"]]
    out = ["Likely categories: " + (", ".join(likely) or "none")]
    for r in good:
        out.append(f"{r['category']}: {r['score']:.4f} (threshold {r['threshold']:.4f}, margin {r['margin']:+.4f}) - {r['decision']}")
        if r["matched_patterns"]:
            out.append("  matched: " + "; ".join(r["matched_patterns"]))
    return "\n".join(out) + "\n"
