"""Reports of collected results: tables of a few rows as JSON, Markdown, CSV, LaTeX."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

#: Rows that a report takes at most; a larger table is a dataset, to be written by its DataFrame.
MOST = 100_000


def rows_of(df: DataFrame) -> list[dict[str, Any]]:
    out = [r.asDict(recursive=True) for r in df.limit(MOST + 1).collect()]
    if len(out) > MOST:
        raise ValueError(f"a report has at most {MOST} rows; write the table instead")
    return out


def _cell(x: Any) -> str:
    return "" if x is None else f"{x:.4f}" if isinstance(x, float) else ", ".join(map(str, x)) if isinstance(x, list | tuple) else str(x)


def to_json(sections: Mapping[str, Sequence[Mapping[str, Any]]]) -> str:
    return json.dumps(sections, ensure_ascii=False, indent=2, default=str)


def to_csv(rows: Sequence[Mapping[str, Any]]) -> str:
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, list(rows[0]), lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
    return out.getvalue()


def to_markdown(title: str, sections: Mapping[str, Sequence[Mapping[str, Any]]]) -> str:
    out = [f"# {title}"]
    for name, rows in sections.items():
        out += ["", f"## {name}", ""]
        if not rows:
            out.append("No rows.")
            continue
        head = list(rows[0])
        out += ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
        out += ["| " + " | ".join(_cell(r[c]).replace("|", "\\|") for c in head) + " |" for r in rows]
    return "\n".join(out) + "\n"


def to_latex(rows: Sequence[Mapping[str, Any]]) -> str:
    if not rows:
        return ""
    head, safe = list(rows[0]), lambda x: _cell(x).replace("\\", "\\textbackslash{}").replace("_", "\\_").replace("%", "\\%").replace("&", "\\&").replace("#", "\\#")
    lines = [" & ".join(map(safe, head)) + " \\\\ \\hline", *(" & ".join(safe(r[c]) for c in head) + " \\\\" for r in rows)]
    return "\\begin{tabular}{" + "l" * len(head) + "}\n" + "\n".join(lines) + "\n\\end{tabular}\n"


def summary(overall: Sequence[Mapping[str, Any]]) -> str:
    """A few sentences of the overall scores."""
    if not overall:
        return "Nothing was evaluated."
    best = max(overall, key=lambda r: r["f1"])
    return " ".join([f"{r['mode']}: F1 {r['f1']:.3f} (precision {r['precision']:.3f}, recall {r['recall']:.3f})." for r in overall] + [f"Best by {best['mode']} match."])


def export(df: DataFrame, folder: str, name: str = "leaderboard", formats: Sequence[str] = ("json", "md", "csv")) -> dict[str, str]:
    """Write a small table in several formats; their paths."""
    rows, out = rows_of(df), {}
    made = {"json": lambda: to_json({name: rows}), "md": lambda: to_markdown(name, {"rows": rows}), "csv": lambda: to_csv(rows), "tex": lambda: to_latex(rows)}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for f in formats:
        path = Path(folder) / f"{name}.{f}"
        path.write_text(made[f](), encoding="utf-8")
        out[f] = str(path)
    return out


def json_array(df: DataFrame, path: str) -> int:
    """The rows as one JSON array, which streams through the driver a partition at a time; how many they are."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in df.toLocalIterator():
            f.write(("," if n else "") + "\n  " + json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))
            n += 1
        f.write("\n]\n")
    return n
