"""Text on the ground: words wrapped into rows, glyph advances, placed cells.

glyphs(code, width) is a table, a parameter of the layout; it has at most one
row per character, so its widths fit a table in each task.  Wrapping is an ordered
fold over one line's tokens: a token that isn't blank moves to the next row if
it would cross the limit; what is missing in the table is counted and takes no
advance of its own, but counts as tracking in a token's width.  Tokens and their
widths are found over arrays of some texts at once, each sum in the order of its
characters; the fold takes one step a token, however long a line is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..plans.fixtures import views

# Tracking and row height as parts of the cap height, narrowest wrap.
TRACKING, ROW, LEAST_WRAP = 0.6, 1.5, 40.0
#: Characters that are laid out at once, unless one text has more.
AT_ONCE = 1_000_000


class Layout:
    """Where the tokens of texts go."""

    def __init__(self, glyphs: list, cap: float, wrap: float | None):
        self.spaced, self.limit = TRACKING * cap, float("inf") if wrap is None else max(wrap, LEAST_WRAP)
        # One entry more, for all characters past the last of the table.
        self.advance = np.zeros(max((code for code, _ in glyphs), default=-1) + 2)
        self.known = np.zeros(len(self.advance), bool)
        for code, width in glyphs:
            if width is not None and code >= 0:
                self.advance[code], self.known[code] = width, True

    def tokens(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of each token: its text, line, place in the line, first and last character (of all texts in a row), width, characters missing, row and x."""
        at = np.cumsum([0, *map(len, texts)])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        n = len(chars)
        ends, blank = chars == 10, chars == 32
        begins = np.ones(n, bool)
        begins[1:] = ends[:-1] | (blank[1:] != blank[:-1])
        begins[at[:-1][at[:-1] < n]] = True
        begins &= ~ends
        last = np.ones(n, bool)
        last[:-1] = ends[1:] | begins[1:]
        first, stop = np.flatnonzero(begins), np.flatnonzero(last & ~ends) + 1
        text = np.searchsorted(at, first, side="right") - 1
        breaks = np.concatenate([[0], np.cumsum(ends)])
        line = breaks[first] - breaks[at[text]]
        i = np.arange(len(first))
        new = np.ones(len(first), bool)
        new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        code = np.minimum(chars, len(self.advance) - 1)
        unknown = np.concatenate([[0], np.cumsum(~self.known[code])])
        width = self._widths(self.advance[code], first, stop - first)
        x, row = self._wrapped(width, blank[first], new)
        return {"text": text, "line": line, "pos": i - np.maximum.accumulate(np.where(new, i, 0)), "first": first, "stop": stop, "width": width, "missing": unknown[stop] - unknown[first], "row": row, "x": x, "chars": chars}

    def _widths(self, advance: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(first))
        order = np.argsort(size, kind="stable")
        sizes, at = np.unique(size[order], return_index=True)
        for k, some in zip(sizes.tolist(), np.split(order, at[1:]) if len(first) else [], strict=True):
            sums = np.full((len(some), 2 * k), self.spaced)
            sums[:, ::2] = advance[first[some][:, None] + np.arange(k)]
            out[some] = np.cumsum(sums, axis=1)[:, -1] - self.spaced
        return out

    def _wrapped(self, width: np.ndarray, blank: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit, spaced, xs, rows, x, row = self.limit, self.spaced, [], [], 0.0, 0
        for w, is_blank, is_new in zip(width.tolist(), blank.tolist(), new.tolist(), strict=True):
            if is_new:
                x, row = 0.0, 0
            elif not is_blank and x > 0 and x + w > limit:
                x, row = 0.0, row + 1
            xs.append(x)
            rows.append(row)
            x = x + w + spaced
        return np.array(xs, float), np.array(rows, int)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts, so many texts at once that they have AT_ONCE characters, or one."""
    for batch in batches:
        size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + AT_ONCE, side="right")) - 1)
            yield batch.column(0).slice(i, j - i), [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
            i = j


def _mapped(texts: DataFrame, glyphs: DataFrame, cap: float, wrap: float | None, key: str, text: str, columns: str, rows) -> DataFrame:
    table = [(r["code"], r["width"]) for r in glyphs.select("code", F.col("width").cast("double")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(table, cap, wrap)
        for keys, some in _some(batches):
            t = layout.tokens(some)
            if len(t["first"]):
                yield pa.RecordBatch.from_pydict(rows(keys, t))

    pair = texts.select(F.col(key), F.col(text).cast("string"))
    return pair.mapInArrow(run, f"`{key}` {pair.schema[0].dataType.simpleString()}, {columns}")


def laid_out(texts: DataFrame, glyphs: DataFrame, cap: float, wrap: float | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, line, pos, row, token, x, width, missing): where each token starts, in glyph units."""

    def rows(keys: pa.Array, t: dict) -> dict:
        chars, ends = t["chars"], np.concatenate([[0], np.cumsum(t["stop"] - t["first"])])
        kept = chars[chars != 10].astype("<u4").tobytes().decode("utf-32-le")
        tokens = [kept[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        small = {k: pa.array(t[k].astype(np.int32)) for k in ("line", "pos", "row")}
        return {key: keys.take(pa.array(t["text"])), **small, "token": pa.array(tokens, pa.string()), "x": pa.array(t["x"]), "width": pa.array(t["width"]), "missing": pa.array(t["missing"].astype(np.int32))}

    return _mapped(texts, glyphs, cap, wrap, key, text, "line int, pos int, row int, token string, x double, width double, missing int", rows)


def extents(texts: DataFrame, glyphs: DataFrame, cap: float, wrap: float | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, tokens, missing, width) of each text with tokens: the sums over its laid_out rows, and how far the widest goes."""

    def rows(keys: pa.Array, t: dict) -> dict:
        some, at = np.unique(t["text"], return_index=True)
        tokens = np.diff(np.append(at, len(t["text"])))
        return {key: keys.take(pa.array(some)), "tokens": pa.array(tokens), "missing": pa.array(np.add.reduceat(t["missing"], at)), "width": pa.array(np.maximum.reduceat(t["x"] + t["width"], at))}

    return _mapped(texts, glyphs, cap, wrap, key, text, "tokens long, missing long, width double", rows)


def block_size(layout: DataFrame, cap: float, key: str = "id") -> DataFrame:
    """(key, width, height): the widest row, at least 1, and rows of 1.5 cap heights."""
    rows = layout.groupBy(key, "line").agg((F.max("row") + 1).alias("rows"), F.max(F.col("x") + F.col("width")).alias("w"))
    return rows.groupBy(key).agg(F.greatest(F.lit(1.0), F.max("w")).alias("width"), (F.sum("rows") * ROW * cap).alias("height"))


def placed(points: DataFrame, anchor: tuple[float, float], heading: str, metres_per_unit: float) -> DataFrame:
    """points(x, y in units) with lat, lon around an anchor along a heading (radians, SQL)."""
    lat, lon = G.project_offset((G.num(anchor[0]), G.num(anchor[1])), heading, f"x * {G.num(metres_per_unit)}", f"y * {G.num(metres_per_unit)}")
    return points.withColumns({"lat": F.expr(lat), "lon": F.expr(lon)})


def text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of document texts with a rule for glyph widths, wrapped at 900 units."""
    docs = views(spark, sf_dir, "{documents}")["documents"].select(F.col("doc_id").alias("id"), "text")
    glyphs = spark.range(32, 127).select(F.col("id").cast("int").alias("code"), (8 + F.col("id") % 13).alias("width"))
    return extents(docs, glyphs, 23.0, 900.0).groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("missing").alias("missing"), F.round(F.max("width"), 3).alias("width"))


QUERIES = {"text_layout": text_layout}
