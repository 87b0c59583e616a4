"""Line diffs by longest common subsequence, for pairs of short texts."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of a text beyond which a diff falls back to "replace all".
MAX_LINES = 2000


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """("=", "-" or "+", line) from a to b; deletions come before insertions where both are possible."""
    if len(a) > MAX_LINES or len(b) > MAX_LINES:
        return [("-", x) for x in a] + [("+", x) for x in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1]):
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out


def line_diff(old: Column, new: Column) -> Column:
    """The script as text, a line each: mark, then the line. Batches of rows go through Arrow."""
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(m + x for m, x in edit_script((s or "").split("\n"), (t or "").split("\n"))) for s, t in zip(a, b, strict=True)])

    return run(old, new)
