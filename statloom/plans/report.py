"""Tables of fitted models as Markdown, LaTeX, HTML or CSV text, and pages of them.

A model is a frame with columns term, estimate and std_error (p_value if known), as the estimators' `frame` returns it:
a row per term, so its size is that of the model.
"""

from __future__ import annotations

import csv
import io
from html import escape

from pyspark.sql import DataFrame

#: Levels of significance and their marks.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))
#: LaTeX's own characters.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
#: Rows that a reported frame may have.
MAX_ROWS = 10_000


def stars(p: float | None) -> str:
    return "" if p is None or p != p else next((s for level, s in STARS if p < level), "")


def _rows(df: DataFrame, max_rows: int = MAX_ROWS) -> list[dict]:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows do not make a table")
    return [r.asDict() for r in rows]


def grid(models: dict[str, DataFrame], digits: int = 3, notes: dict[str, dict[str, object]] | None = None) -> list[list[str]]:
    """A row of names, then per term a row of estimates with stars and one of standard errors; `notes` adds rows (such as n)
    of a value per model. Terms come in the order of their first model."""
    told = {name: {r["term"]: r for r in _rows(df)} for name, df in models.items()}
    terms = list(dict.fromkeys(t for rows in told.values() for t in rows))
    out = [["", *models]]
    for term in terms:
        found = [told[m].get(term) for m in models]
        out.append([term, *("" if r is None else f"{r['estimate']:.{digits}f}{stars(r.get('p_value'))}" for r in found)])
        out.append(["", *("" if r is None or r.get("std_error") is None else f"({r['std_error']:.{digits}f})" for r in found)])
    for label, values in (notes or {}).items():
        out.append([label, *(str(values.get(m, "")) for m in models)])
    return out


def of_frame(df: DataFrame, digits: int = 6, max_rows: int = MAX_ROWS) -> list[list[str]]:
    """Any bounded frame as cells; nulls are empty."""
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    return [list(df.columns), *([show(v) for v in r.values()] for r in _rows(df, max_rows))]


def markdown(cells: list[list[str]], title: str = "") -> str:
    safe = [[c.replace("|", "\\|").replace("\n", " ") for c in row] for row in cells]
    lines = ["| " + " | ".join(row) + " |" for row in safe]
    rule = "|" + "|".join([" --- "] + [" ---: "] * (len(cells[0]) - 1)) + "|"
    return (f"**{title}**\n\n" if title else "") + "\n".join([lines[0], rule, *lines[1:]]) + "\n"


def latex(cells: list[list[str]], title: str = "", label: str = "") -> str:
    safe = [["".join(_LATEX.get(ch, ch) for ch in c) for c in row] for row in cells]
    body = [" & ".join(row) + r" \\" for row in safe]
    out = [r"\begin{table}[htbp]", r"\centering"]
    out += [rf"\caption{{{''.join(_LATEX.get(ch, ch) for ch in title)}}}"] if title else []
    out += [rf"\label{{{label}}}"] if label else []
    out += [rf"\begin{{tabular}}{{l{'c' * (len(cells[0]) - 1)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}", r"\end{table}"]
    return "\n".join(out) + "\n"


def html(cells: list[list[str]], title: str = "") -> str:
    line = lambda row, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in row) + "</tr>"
    head = f"<caption>{escape(title)}</caption>" if title else ""
    return f"<table>{head}<thead>{line(cells[0], 'th')}</thead><tbody>{''.join(line(r, 'td') for r in cells[1:])}</tbody></table>\n"


def csv_text(cells: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(cells)
    return out.getvalue()


def page(title: str, parts: list[tuple[str, str]], subtitle: str = "") -> str:
    """An HTML page of (heading, HTML) parts: tables of `html`, pictures of `charts`."""
    body = "".join(f"<section><h2>{escape(h)}</h2>{content}</section>" for h, content in parts)
    sub = f"<p>{escape(subtitle)}</p>" if subtitle else ""
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}th,td{padding:.2em .8em;text-align:right}th:first-child,td:first-child{text-align:left}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{sub}{body}</body></html>\n'
