"""Charts as SVG text. Rows are reduced by Spark before they are drawn: scatters to counts per cell, boxes to quantiles, lines
to means per bin; so a chart's size never depends on the number of rows. Model charts take the model's frame."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size and margin of a picture, and its colours.
WIDTH, HEIGHT, MARGIN = 640, 400, 50
COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2")


class _Plane:
    """Marks in data coordinates."""

    def __init__(self, x: tuple[float, float], y: tuple[float, float], title: str, x_label: str = "", y_label: str = ""):
        self.x = x if x[0] < x[1] else (x[0] - 0.5, x[1] + 0.5)
        self.y = y if y[0] < y[1] else (y[0] - 0.5, y[1] + 0.5)
        self.marks: list[str] = []
        self.title, self.x_label, self.y_label = title, x_label, y_label

    def at(self, x: float, y: float) -> tuple[float, float]:
        across = MARGIN + (x - self.x[0]) / (self.x[1] - self.x[0]) * (WIDTH - 2 * MARGIN)
        return across, HEIGHT - MARGIN - (y - self.y[0]) / (self.y[1] - self.y[0]) * (HEIGHT - 2 * MARGIN)

    def line(self, points, colour=COLOURS[0], dash=""):
        told = " ".join("{:.1f},{:.1f}".format(*self.at(*p)) for p in points)
        self.marks.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5"{f" stroke-dasharray={chr(34)}{dash}{chr(34)}" if dash else ""} points="{told}"/>')

    def dot(self, x, y, hint="", colour=COLOURS[0], radius=3.5):
        a, b = self.at(x, y)
        self.marks.append(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="{radius}" fill="{colour}"><title>{escape(hint)}</title></circle>')

    def box(self, x0, y0, x1, y1, hint="", colour=COLOURS[0], opacity=1.0):
        (a, b), (c, d) = self.at(x0, y0), self.at(x1, y1)
        self.marks.append(f'<rect x="{min(a, c):.1f}" y="{min(b, d):.1f}" width="{abs(c - a):.1f}" height="{abs(d - b):.1f}" fill="{colour}" fill-opacity="{opacity:.3f}"><title>{escape(hint)}</title></rect>')

    def text(self, x, y, said, anchor="middle"):
        a, b = self.at(x, y)
        self.marks.append(f'<text x="{a:.1f}" y="{b:.1f}" font-size="10" text-anchor="{anchor}">{escape(str(said))}</text>')

    def svg(self, x_ticks: list[tuple[float, str]] | None = None, y_ticks: list[tuple[float, str]] | None = None) -> str:
        left, right, low, high = MARGIN, WIDTH - MARGIN, HEIGHT - MARGIN, MARGIN
        even = lambda span: [(span[0] + (span[1] - span[0]) * i / 4, f"{span[0] + (span[1] - span[0]) * i / 4:.4g}") for i in range(5)]
        out = [f'<path d="M{left} {high}V{low}H{right}" fill="none" stroke="#888"/>']
        out += [f'<text x="{self.at(v, self.y[0])[0]:.1f}" y="{low + 16}" font-size="10" text-anchor="middle">{escape(s)}</text>' for v, s in (x_ticks or even(self.x))]
        out += [f'<text x="{left - 6}" y="{self.at(self.x[0], v)[1] + 3:.1f}" font-size="10" text-anchor="end">{escape(s)}</text>' for v, s in (y_ticks or even(self.y))]
        out += [f'<text x="{WIDTH / 2}" y="20" font-size="14" text-anchor="middle">{escape(self.title)}</text>', f'<text x="{WIDTH / 2}" y="{HEIGHT - 12}" font-size="11" text-anchor="middle">{escape(self.x_label)}</text>']
        out += [f'<text x="14" y="{HEIGHT / 2}" font-size="11" text-anchor="middle" transform="rotate(-90 14 {HEIGHT / 2})">{escape(self.y_label)}</text>'] if self.y_label else []
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif">{"".join(out + self.marks)}</svg>\n'


def _span(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    row = df.agg(*(f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max))).first()
    if any(v is None for v in row):
        raise ValueError("there are no values to draw")
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(columns))]


def _cell(column: str, span: tuple[float, float], bins: int) -> Column:
    width = (span[1] - span[0]) / bins or 1.0
    return F.least(F.floor((F.col(column).cast("double") - span[0]) / width), F.lit(bins - 1))


def cells(df: DataFrame, x: str, y: str, bins: int = 60) -> tuple[list[tuple[int, int, int]], tuple[float, float], tuple[float, float]]:
    """(cell across, cell up, rows) of a grid over both columns, and the grid's spans. Rows with a null are left out."""
    rows = df.select(x, y).dropna()
    across, up = _span(rows, x, y)
    got = rows.groupBy(_cell(x, across, bins).alias("i"), _cell(y, up, bins).alias("j")).agg(F.count("*").alias("n")).orderBy("i", "j").collect()  # at most bins ** 2 rows
    return [(r["i"], r["j"], r["n"]) for r in got], across, up


def scatter(df: DataFrame, x: str, y: str, title: str = "", bins: int = 60) -> str:
    """Counts per cell, darker where there are more rows."""
    found, across, up = cells(df, x, y, bins)
    plane, most = _Plane(across, up, title, x, y), max(n for _, _, n in found)
    w, h = (plane.x[1] - plane.x[0]) / bins, (plane.y[1] - plane.y[0]) / bins
    for i, j, n in found:
        plane.box(plane.x[0] + i * w, plane.y[0] + j * h, plane.x[0] + (i + 1) * w, plane.y[0] + (j + 1) * h, f"{n} rows", opacity=0.2 + 0.8 * n / most)
    return plane.svg()


def histogram(df: DataFrame, column: str, bins: int = 30, title: str = "") -> str:
    rows = df.select(column).dropna()
    (span,) = _span(rows, column)
    found = rows.groupBy(_cell(column, span, bins).alias("i")).agg(F.count("*").alias("n")).orderBy("i").collect()  # at most bins rows
    plane = _Plane(span, (0, max(r["n"] for r in found)), title, column, "rows")
    w = (plane.x[1] - plane.x[0]) / bins
    for r in found:
        plane.box(plane.x[0] + r["i"] * w, 0, plane.x[0] + (r["i"] + 1) * w, r["n"], f"{r['n']} rows")
    return plane.svg()


def line(df: DataFrame, x: str, ys: list[str], title: str = "", bins: int = 200) -> str:
    """Means of the columns per bin of x."""
    rows = df.select(x, *ys).dropna(subset=[x])
    (span,) = _span(rows, x)
    found = rows.groupBy(_cell(x, span, bins).alias("i")).agg(F.avg(F.col(x).cast("double")).alias("__x"), *(F.avg(F.col(c).cast("double")).alias(f"__{k}") for k, c in enumerate(ys))).orderBy("i").collect()  # at most bins rows
    values = [r[f"__{k}"] for r in found for k in range(len(ys)) if r[f"__{k}"] is not None]
    plane = _Plane(span, (min(values), max(values)), title, x, ", ".join(ys))
    for k in range(len(ys)):
        plane.line([(r["__x"], r[f"__{k}"]) for r in found if r[f"__{k}"] is not None], COLOURS[k % len(COLOURS)])
    return plane.svg()


def box(df: DataFrame, value: str, group: str, title: str = "", most: int = 50) -> str:
    """Quartiles, and whiskers to the outermost values within 1.5 quartile ranges; refuses more than `most` groups."""
    v = F.col(value).cast("double")
    parts = df.where(v.isNotNull()).groupBy(group).agg(F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000).alias("__q"), F.count("*").alias("__n")).orderBy(group).limit(most + 1).collect()
    if not parts or len(parts) > most:
        raise ValueError(f"a box chart takes 1 to {most} groups")
    reach = df.sparkSession.createDataFrame([(r[group], r["__q"][0], r["__q"][2]) for r in parts], f"`{group}` {dict(df.dtypes)[group]}, __a double, __b double")
    inside = v.between(F.col("__a") - 1.5 * (F.col("__b") - F.col("__a")), F.col("__b") + 1.5 * (F.col("__b") - F.col("__a")))
    joined = df.select(group, value).alias("d").join(F.broadcast(reach).alias("r"), F.col(f"d.{group}").eqNullSafe(F.col(f"r.{group}"))).select(F.col(f"d.{group}").alias(group), value, "__a", "__b")
    ends = {r[group]: (r["lo"], r["hi"], r["out"]) for r in joined.where(v.isNotNull()).groupBy(group).agg(F.min(F.when(inside, v)).alias("lo"), F.max(F.when(inside, v)).alias("hi"), F.count_if(~inside).alias("out")).collect()}  # a row per group
    plane = _Plane((0, len(parts)), (min(e[0] for e in ends.values()), max(e[1] for e in ends.values())), title, group, value)
    for i, r in enumerate(parts):
        low, high, out = ends[r[group]]
        plane.line([(i + 0.5, low), (i + 0.5, high)], "#555")
        plane.box(i + 0.2, r["__q"][0], i + 0.8, r["__q"][2], f"{r['__n']} rows, {out} beyond the whiskers", opacity=0.6)
        plane.line([(i + 0.2, r["__q"][1]), (i + 0.8, r["__q"][1])], "#000")
    return plane.svg(x_ticks=[(i + 0.5, str(r[group])) for i, r in enumerate(parts)])


def coefficients(fit: DataFrame, title: str = "", z: float = 1.96, most: int = 60) -> str:
    """Estimates of a model's frame with their intervals; refuses more than `most` terms."""
    rows = fit.select("term", "estimate", "std_error").limit(most + 1).collect()
    if not rows or len(rows) > most:
        raise ValueError(f"a chart of coefficients takes 1 to {most} terms")
    wide = [(r["term"], r["estimate"], z * (r["std_error"] or 0.0)) for r in rows]
    plane = _Plane((min(0.0, *(e - w for _, e, w in wide)), max(0.0, *(e + w for _, e, w in wide))), (0, len(wide)), title, "estimate")
    plane.line([(0, 0), (0, len(wide))], "#888", "4 3")
    for i, (term, e, w) in enumerate(wide):
        plane.line([(e - w, len(wide) - i - 0.5), (e + w, len(wide) - i - 0.5)])
        plane.dot(e, len(wide) - i - 0.5, f"{term}: {e:.4g}")
    return plane.svg(y_ticks=[(len(wide) - i - 0.5, t) for i, (t, _, _) in enumerate(wide)])


def path(points: DataFrame, place: str, value: str, error: str | None = None, title: str = "", z: float = 1.96, mark: float | None = None, most: int = 1000) -> str:
    """Estimates by place with a band of their errors: event studies (`mark` the last period before), impulse responses."""
    rows = points.select(F.col(place).cast("double").alias("p"), F.col(value).cast("double").alias("v"), (F.col(error).cast("double") if error else F.lit(0.0)).alias("e")).dropna(subset=["p", "v"]).orderBy("p").limit(most + 1).collect()
    if not rows or len(rows) > most:
        raise ValueError(f"a path takes 1 to {most} places")
    told = [(r["p"], r["v"], z * (r["e"] or 0.0)) for r in rows]
    plane = _Plane((told[0][0], told[-1][0]), (min(0.0, *(v - w for _, v, w in told)), max(0.0, *(v + w for _, v, w in told))), title, place, value)
    plane.line([(plane.x[0], 0), (plane.x[1], 0)], "#888", "4 3")
    if mark is not None:
        plane.line([(mark, plane.y[0]), (mark, plane.y[1])], "#888", "4 3")
    for p, v, w in told:
        plane.line([(p, v - w), (p, v + w)], COLOURS[1])
        plane.dot(p, v, f"{p:g}: {v:.4g}")
    plane.line([(p, v) for p, v, _ in told])
    return plane.svg()


def heatmap(names: list[str], matrix, title: str = "") -> str:
    """A matrix of correlations: blue above zero, red below."""
    n = len(names)
    plane = _Plane((0, n), (0, n), title)
    for i in range(n):
        for j in range(n):
            v = float(matrix[i][j])
            plane.box(j, n - i - 1, j + 1, n - i, f"{names[i]}, {names[j]}: {v:.3f}", COLOURS[0] if v >= 0 else COLOURS[3], min(1.0, abs(v)))
            plane.text(j + 0.5, n - i - 0.55, f"{v:.2f}")
    return plane.svg([(j + 0.5, c) for j, c in enumerate(names)], [(n - i - 0.5, c) for i, c in enumerate(names)])


def residuals(df: DataFrame, fitted: str, residual: str, bins: int = 60) -> list[str]:
    """Residuals against fitted values, and their histogram."""
    return [scatter(df, fitted, residual, "Residuals and fitted values", bins), histogram(df, residual, 30, "Residuals")]
